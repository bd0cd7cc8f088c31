"""Work on field names: making them safe for columns, and masking by name."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters a column name may not hold, and their stand-in.
UNSAFE = ".$"
SAFE = "_"

# A field whose name contains one of these is masked.
SENSITIVE = (
    "authorization",
    "password",
    "secret",
    "token",
    "uri",
    "cpf",
    "cnpj",
    "email",
    "keymaterial",
)
MASK = "<mascarado>"


def safe_name(name: str) -> str:
    return name.translate({ord(c): SAFE for c in UNSAFE})


def safe_name_column(name: Column) -> Column:
    return F.translate(name, UNSAFE, SAFE * len(UNSAFE))


def _later_wins(fields: list[T.StructField]) -> dict[str, T.StructField]:
    kept: dict[str, T.StructField] = {}
    for field in fields:
        kept[safe_name(field.name)] = field
    return kept


def _renames(data_type: T.DataType) -> bool:
    """Whether any name below ``data_type`` changes."""
    if isinstance(data_type, T.StructType):
        return any(safe_name(f.name) != f.name or _renames(f.dataType) for f in data_type.fields)
    if isinstance(data_type, T.ArrayType):
        return _renames(data_type.elementType)
    return isinstance(data_type, T.MapType)


def _safe(value: Column, data_type: T.DataType) -> Column:
    if not _renames(data_type):
        return value
    if isinstance(data_type, T.StructType):
        parts = [
            _safe(value.getField(field.name), field.dataType).alias(name)
            for name, field in _later_wins(data_type.fields).items()
        ]
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(data_type, T.ArrayType):
        return F.transform(value, lambda item: _safe(item, data_type.elementType))
    # Map keys are field names too.  Their order within the map decides which one
    # of two clashing keys stays, so the last entry of each name is kept.
    names = F.transform(F.map_keys(value), safe_name_column)
    values = F.transform(F.map_values(value), lambda item: _safe(item, data_type.valueType))
    last = F.filter(
        F.sequence(F.lit(1), F.size(names)),
        lambda i: ~F.array_contains(F.slice(names, i + 1, F.size(names)), F.get(names, i - 1)),
    )
    rebuilt = F.map_from_arrays(
        F.transform(last, lambda i: F.get(names, i - 1)), F.transform(last, lambda i: F.get(values, i - 1))
    )
    return F.when(value.isNotNull(), F.when(F.size(value) > 0, rebuilt).otherwise(value))


def sanitise(frame: DataFrame) -> DataFrame:
    """Replaces ``.`` and ``$`` by ``_`` in every field name, at any depth.

    Of two names that become equal the later field stays.
    """
    return frame.select(
        *[
            _safe(column(field.name), field.dataType).alias(name)
            for name, field in _later_wins(frame.schema.fields).items()
        ]
    )


def column(name: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`{}`".format(name.replace("`", "``")))


def _is_sensitive(name: str) -> bool:
    return re.search("|".join(SENSITIVE), name, re.IGNORECASE) is not None


def _masked(value: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.StructType):
        parts = [
            (F.lit(MASK) if _is_sensitive(f.name) else _masked(value.getField(f.name), f.dataType)).alias(f.name)
            for f in data_type.fields
        ]
        return F.when(value.isNotNull(), F.struct(*parts)) if parts else value
    if isinstance(data_type, T.ArrayType):
        return F.transform(value, lambda item: _masked(item, data_type.elementType))
    if isinstance(data_type, T.MapType) and isinstance(data_type.valueType, T.StringType):
        pattern = "(?i)" + "|".join(SENSITIVE)
        return F.transform_values(value, lambda k, v: F.when(k.rlike(pattern), F.lit(MASK)).otherwise(v))
    if isinstance(data_type, T.MapType):
        # A typed value cannot hold the mask text, so a masked entry becomes NULL.
        pattern = "(?i)" + "|".join(SENSITIVE)
        return F.transform_values(
            value, lambda k, v: F.when(~k.rlike(pattern), _masked(v, data_type.valueType))
        )
    return value


def mask_by_name(frame: DataFrame) -> DataFrame:
    """Replaces the value of every sensitively named field, at any depth, by a mask."""
    return frame.select(
        *[
            (F.lit(MASK) if _is_sensitive(f.name) else _masked(column(f.name), f.dataType)).alias(f.name)
            for f in frame.schema.fields
        ]
    )
