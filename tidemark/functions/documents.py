"""Relaxed Extended JSON documents as Spark values.

Plain JSON cannot carry dates, decimals or binary data; a feed wraps them in
one-key objects.  A wrapper is recognised by the exact type Spark's
``schema_of_variant`` reports for it, before any field name is rewritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.names import column

# Extended JSON wrappers and the kind each one stands for.
WRAPPERS = {
    "OBJECT<`$date`: STRING>": "timestamp",
    "OBJECT<`$date`: OBJECT<`$numberLong`: STRING>>": "timestamp",
    "OBJECT<`$oid`: STRING>": "string",
    "OBJECT<`$numberDecimal`: STRING>": "decimal128",
    "OBJECT<`$numberLong`: STRING>": "bigint",
    "OBJECT<`$numberInt`: STRING>": "bigint",
    "OBJECT<`$numberDouble`: STRING>": "double",
    "OBJECT<`$binary`: OBJECT<base64: STRING, subType: STRING>>": "binary",
    "OBJECT<`$timestamp`: OBJECT<i: BIGINT, t: BIGINT>>": "timestamp",
    "OBJECT<`$uuid`: STRING>": "string",
    "OBJECT<`$regularExpression`: OBJECT<options: STRING, pattern: STRING>>": "string",
    "OBJECT<`$minKey`: BIGINT>": "string",
    "OBJECT<`$maxKey`: BIGINT>": "string",
}

SCALARS = {
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "binary": T.BinaryType(),
}

# The other types schema_of_variant reports, without their parameters.
PLAIN = {
    "BIGINT": "bigint",
    "DECIMAL": "double",
    "DOUBLE": "double",
    "FLOAT": "double",
    "STRING": "string",
    "BOOLEAN": "boolean",
    "OBJECT": "object",
    "ARRAY": "array",
}


def _lookup(table: dict[str, str], name: Column) -> Column:
    return F.create_map(*[F.lit(part) for pair in table.items() for part in pair])[name]


def kind_of_form(form: Column) -> Column:
    """The kind of a value by what ``schema_of_variant`` says of it."""
    return F.coalesce(_lookup(WRAPPERS, form), _lookup(PLAIN, F.regexp_extract(form, "^[A-Z]+", 0)))


def kind_of(value: Column) -> Column:
    """The kind of a variant: a scalar name, object, array, decimal128, or NULL."""
    return kind_of_form(F.schema_of_variant(value))


def scalar(value: Column, kind: str) -> Column:
    """A variant already known to be of ``kind`` as a typed column."""

    def at(path: str, as_type: str) -> Column:
        return F.try_variant_get(value, path, as_type)

    if kind == "bigint":
        return F.coalesce(at("$", "bigint"), at('$["$numberLong"]', "bigint"), at('$["$numberInt"]', "bigint"))
    if kind == "double":
        return F.coalesce(at("$", "double"), at('$["$numberDouble"]', "double"))
    if kind == "string":
        pattern = F.concat(
            F.lit("/"), at('$["$regularExpression"].pattern', "string"), F.lit("/"), at('$["$regularExpression"].options', "string")
        )
        ends = [F.when(at(f'$["{end}"]', "bigint").isNotNull(), end[1:]) for end in ("$minKey", "$maxKey")]
        return F.coalesce(at('$["$oid"]', "string"), at('$["$uuid"]', "string"), pattern, *ends, at("$", "string"))
    if kind == "boolean":
        return at("$", "boolean")
    if kind == "timestamp":
        millis = at('$["$date"]["$numberLong"]', "bigint")
        seconds = F.timestamp_seconds(at('$["$timestamp"].t', "bigint"))
        return F.coalesce(F.timestamp_millis(millis), at('$["$date"]', "timestamp"), seconds)
    if kind == "binary":
        return F.try_to_binary(at('$["$binary"].base64', "string"), F.lit("base64"))
    raise ValueError(f"no Spark type for {kind}")


def _encodable(value: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.StructType):
        parts = [_encodable(value.getField(f.name), f.dataType).alias(f.name) for f in data_type.fields]
        return F.when(value.isNotNull(), F.struct(*parts)) if parts else value
    if isinstance(data_type, T.ArrayType):
        return F.transform(value, lambda item: _encodable(item, data_type.elementType))
    if isinstance(data_type, T.MapType):
        return F.transform_values(value, lambda _, item: _encodable(item, data_type.valueType))
    if isinstance(data_type, T.DateType):
        value, data_type = value.cast("timestamp_ntz"), T.TimestampNTZType()
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        if isinstance(data_type, T.TimestampNTZType):
            text = F.concat(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
        return F.when(value.isNotNull(), F.struct(text.alias("$date")))
    if isinstance(data_type, T.DecimalType):
        return F.when(value.isNotNull(), F.struct(value.cast("string").alias("$numberDecimal")))
    if isinstance(data_type, T.BinaryType):
        body = F.struct(F.base64(value).alias("base64"), F.lit("00").alias("subType"))
        return F.when(value.isNotNull(), F.struct(body.alias("$binary")))
    return value


def encode_document(frame: DataFrame) -> Column:
    """Each row of ``frame`` as one Extended JSON document; NULL fields are left out."""
    return F.to_json(
        F.struct(*[_encodable(column(f.name), f.dataType).alias(f.name) for f in frame.schema.fields])
    )
