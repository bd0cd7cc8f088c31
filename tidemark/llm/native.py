"""Column helpers of the native operators: text rules and a blocked Bloom filter, in Spark's own functions."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most 64-bit blocks a filter may have. It bounds what is broadcast, whatever the list's length;
#: a longer list only lets more rows through to the exact join behind the filter.
MAX_BLOCKS = 1 << 18
BLANKS = " \t\n\x0b\x0c\r"


def lower_az(text: Column) -> Column:
    """A-Z in lower case and nothing else. Spark's quicker ``lower`` does for texts of ASCII alone."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def hash128(text: Column) -> Column:
    """A 128-bit content hash, as 16 bytes."""
    return F.unhex(F.md5(text))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _mask(key: Column) -> Column:
    """Four bits of one 64-bit block, from a second hash of the key."""
    second = F.xxhash64(key, F.lit(1))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(second, 6 * i).bitwiseAND(63).cast("int")) for i in range(4)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def bloom(listed: DataFrame, key: Column, blocks: int = MAX_BLOCKS) -> DataFrame:
    """A blocked Bloom filter of the listed keys: one row for each block that has bits, ``blocks`` rows at most."""
    if not 0 < blocks <= MAX_BLOCKS:
        raise ValueError(f"blocks must be between 1 and {MAX_BLOCKS}")
    bits = listed.where(key.isNotNull()).select(_block(key, blocks).alias("__block"), _mask(key).alias("__mask"))
    return bits.groupBy("__block").agg(F.bit_or("__mask").alias("__bits"))


def packed(frame: DataFrame) -> DataFrame:
    """All columns as one struct ``row``, so that no name of theirs meets one of an operator's."""
    return frame.select(F.struct(*[F.col(quoted(c)) for c in frame.columns]).alias("row"))


def field(name: str) -> Column:
    return F.col("row").getField(name)


def unpacked(frame: DataFrame, names: list[str]) -> DataFrame:
    return frame.select(*[field(c).alias(c) for c in names])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def probed(rows: DataFrame, key: Column, filter_rows: DataFrame, name: str, blocks: int = MAX_BLOCKS) -> DataFrame:
    """The rows with boolean ``name``: false where the filter rules the key out. The filter's size is bounded, so it is broadcast."""
    mask = _mask(key)
    joined = rows.join(F.broadcast(filter_rows), _block(key, blocks) == F.col("__block"), "left")
    return joined.withColumn(name, F.coalesce(F.col("__bits").bitwiseAND(mask) == mask, F.lit(False))).drop("__block", "__bits")


def renamed(frame: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under the operator's own names; others of any name stay out of its way."""
    return frame.select(*[F.col(quoted(old)).alias(new) for new, old in names.items()])


def without(rows: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """The rows, all columns, whose ``key`` (of ``field``s) is not in ``gone``'s column ``key``; NULLs inside a key are equal.

    A filter lets most rows through where they are; only possible hits move.
    """
    own = packed(rows).withColumn("key", F.struct(key))
    lost = gone.select(F.struct("key").alias("lost")).distinct()
    marked = probed(own, F.col("key"), bloom(lost, F.col("lost")), "maybe")
    asked = marked.where("maybe").join(lost, F.col("key") == F.col("lost"), "left_anti")
    return unpacked(marked.where("NOT maybe").unionByName(asked), rows.columns)
