"""Text and number rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is cut out of error text, in this order: the text a match
# must contain (None: look always), the pattern, its stand-in.
# (?U) gives \w, \d and \s their Unicode meaning.  Twelve digits standing alone are
# looked for by their digits first, which costs one step per other character.
REDACTIONS = (
    ("mongodb", r"(?U)mongodb(?:\+srv)?://[^\s'\"]+", "mongodb://<redacted>"),
    (".mongodb", r"(?U)\b[\w.-]+\.mongodb(?:-dev)?\.net(?::\d+)?\b", "<cluster-host>"),
    ("AKIA", r"(?U)\bAKIA[A-Z0-9]{16}\b", "<aws-id>"),
    ("ASIA", r"(?U)\bASIA[A-Z0-9]{16}\b", "<aws-id>"),
    (None, r"(?U)\d{12}(?!\w)(?<!\w\d{12})", "<aws-id>"),
)
ERROR_TEXT_LIMIT = 300

# Accepted identifiers.
ORDER_ID = r"\A[A-Za-z0-9][A-Za-z0-9_-]{0,127}\z"
QUERY_ID = r"\A[A-Za-z0-9][A-Za-z0-9_-]{0,79}\z"
MAX_SNAPSHOT_ID = 9223372036854775807

NUMBER = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"


def redact(text: Column) -> Column:
    """Removes connection strings, cluster hosts and account ids from the whole text.

    The patterns run over the texts that hold their fixed part; most do not.
    """

    def step(needle: str | None, pattern: str, stand_in: str):
        def clean(t: Column) -> Column:
            cleaned = F.regexp_replace(t, F.lit(pattern), F.lit(stand_in))
            return cleaned if needle is None else F.when(t.contains(needle), cleaned).otherwise(t)

        return clean

    steps = F.array(text)
    for redaction in REDACTIONS:
        steps = F.transform(steps, step(*redaction))
    return F.get(steps, F.lit(0))


def error_text(text: Column, limit: int = ERROR_TEXT_LIMIT) -> Column:
    """Redacted text, cut to ``limit`` characters afterwards."""
    return cut(redact(text), limit)


def cut(redacted: Column, limit: int = ERROR_TEXT_LIMIT) -> Column:
    return F.substring(redacted, 1, limit)


def is_order_id(value: Column) -> Column:
    return F.coalesce(value.rlike(ORDER_ID), F.lit(False))


def is_query_id(value: Column) -> Column:
    return F.coalesce(value.rlike(QUERY_ID), F.lit(False))


def is_snapshot_id(value: Column) -> Column:
    """A whole number from 1 to 2^63 - 1, given as text or number."""
    text = value.cast("string")
    number = F.when(text.rlike(r"\A[0-9]+\z"), text.try_cast("bigint"))
    return F.coalesce(number.between(1, MAX_SNAPSHOT_ID), F.lit(False))


def lenient_double(value: Column) -> Column:
    """A number from a value of any scalar type, 1 for true; 0 where there is none."""
    text = value.cast("string")
    true = (F.typeof(value) == "boolean") & (text == "true")
    return F.when(true, F.lit(1.0)).otherwise(F.coalesce(F.when(text.rlike(NUMBER), text.try_cast("double")), F.lit(0.0)))
