"""Vectors as rows of whole numbers, the form in which the vector operators compute exactly."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.native import quoted

#: Components of this size and more would let a squared distance leave a long.
LIMIT = 1 << 24
#: Rows that are compared with all entries or centroids at a time.
SLICE = 4096


def whole(column: pa.Array, scale: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that count, and their components as ``floor(scale * x)``, ``x`` as double.

    A row counts if it has ``width`` components, none of them NULL, not finite or, scaled, of size ``LIMIT`` or more.
    """
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == width)
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    x = np.floor(flat.reshape(len(rows), width) * scale)
    good = (np.abs(x) < LIMIT).all(axis=1)
    return rows[good], x[good].astype(np.int64)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column, each of ``width`` numbers, as rows of an array."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of an array as a list column."""
    ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(x.reshape(-1), kind))


def widths(rows: DataFrame, vector: str) -> DataFrame:
    """width, n: how many vectors have each number of components."""
    size = F.size(F.col(quoted(vector)))
    return rows.where(size > 0).groupBy(size.alias("width")).agg(F.count(F.lit(1)).alias("n"))


def numbered(rows: DataFrame, scale: int, width: int, also: Callable[[np.ndarray], list[pa.Array]] | None = None, fields: str = "") -> DataFrame:
    """``rows``, whose last column is the vector, without those that do not count and with ``v``, the vector's whole numbers.

    ``also`` works out further columns, named by ``fields``, from the numbers in the same pass.
    """
    names = rows.columns[:-1]
    schema = ", ".join([f"{quoted(n)} {t}" for n, t in rows.dtypes[:-1]] + ["v array<int>"] + ([fields] if fields else []))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = whole(batch.column(len(names)), scale, width)
            own = [batch.column(i).take(pa.array(at)) for i in range(len(names))]
            columns = own + [lists(x, pa.int32())] + (also(x) if also else [])
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "v", *[f.split()[0] for f in fields.split(", ") if f]])

    return rows.mapInArrow(convert, schema)


def part_sums(labels: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Componentwise sums and row counts of each of ``k`` labels."""
    order = np.argsort(labels, kind="stable")
    ordered = labels[order]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])
    sums = np.zeros((k, x.shape[1]), np.int64)
    if len(starts):
        sums[ordered[starts]] = np.add.reduceat(x[order], starts)
    return sums, np.bincount(labels, minlength=k)
