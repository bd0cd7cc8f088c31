"""Turning feed documents into typed rows: names, schema evolution, type check.

The schema only grows, and the first type seen for a field stays.  A document
that does not fit is set aside with its reason; it never stops the others.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.documents import SCALARS, kind_of, kind_of_form, scalar
from tidemark.functions.names import safe_name
from tidemark.session import shared_dir
from tidemark.sources.feed import MISSING_POST_IMAGE, lacks_post_image

KEY = "_id"
SEQ, AT, ALIVE, COMMIT, BUCKET = "__seq", "__at", "__alive", "__commit", "__bucket"
_REASON, _TEXT = "__reason", "__text"
OWN = (SEQ, AT, ALIVE, COMMIT, BUCKET, _REASON, _TEXT)

# The reasons a reject carries.
TYPE_REASON = "Unexpected BSON type of {got} for iceberg column name {column} of type {want}"
DECIMAL_REASON = "Decimal128"
CASE_REASON = "case-insensitive name collision"
RESERVED_REASON = "reserved field name"
UNREADABLE_REASON = "not a readable document"
UNREAD_VALUE_REASON = "a wrapped value that cannot be read"
NO_KEY_REASON = "no document key"

WIDE_REASON = "more fields than a table holds"

# Fields that a table holds, at all depths together.
WIDTH = 10_000

# How schema_of_variant writes decimals; and the forms that do not tell every value's
# type: mixed arrays, wrapped values in arrays, field names that look like a decimal (the
# quoted names before are passed over in pairs of quotes, so that one's end opens no name).
DECIMAL_FORM = r"DECIMAL\([0-9]+,[0-9]+\)"
UNCLEAR_FORM = r"ARRAY<.*(VARIANT|\$)|^[^`]*+(?:`(?:(?!DECIMAL\()[^`])*+`[^`]*+)*+`[^`]*DECIMAL\("
# A form without any of these cannot match it.
UNCLEAR_SIGNS = ("ARRAY<", "DECIMAL(")
# Nesting levels that one aggregation looks at.
LEVELS = 4

# Kinds a column of each kind takes; anything else is a type conflict.
_TAKES = {"double": ("double", "bigint")}
_FROM_SPARK = {type(t): kind for kind, t in SCALARS.items()}


@dataclass
class Shape:
    """A field's kind and, below objects and arrays, its parts.

    ``raw`` lists, per column, the names the batch has for it; ``refused`` the
    names that cannot become columns.  ``wrapped`` tells that values of a scalar
    came in a one-key object; ``closed`` that names not listed are too many to be known.
    """

    kind: str
    wrapped: bool = False
    fields: dict[str, Shape] = field(default_factory=dict)
    raw: dict[str, list[str]] = field(default_factory=dict)
    refused: dict[str, str] = field(default_factory=dict)
    element: Shape | None = None
    closed: bool = False

    def spark_type(self) -> T.DataType | None:
        """The column type; None while nothing but emptiness was seen."""
        if self.kind == "object":
            parts = [(n, s.spark_type()) for n, s in self.fields.items()]
            known = [T.StructField(n, t) for n, t in parts if t is not None]
            return T.StructType(known) if known else None
        if self.kind == "array":
            inner = self.element.spark_type() if self.element else None
            return T.ArrayType(inner) if inner is not None else None
        return SCALARS.get(self.kind)

    @property
    def clashes(self) -> bool:
        """Whether two raw names fall on one column anywhere below."""
        below = [*self.fields.values(), *([self.element] if self.element else [])]
        return any(len(names) > 1 for names in self.raw.values()) or any(s.clashes for s in below)


def _shape(data_type: T.DataType) -> Shape:
    if isinstance(data_type, T.StructType):
        return Shape("object", fields={f.name: _shape(f.dataType) for f in data_type.fields})
    if isinstance(data_type, T.ArrayType):
        return Shape("array", element=_shape(data_type.elementType))
    kind = _FROM_SPARK.get(type(data_type))
    if kind is None:
        raise TypeError(f"no table column has the type {data_type.simpleString()}")
    return Shape(kind)


def table_type(source: T.StructType) -> T.StructType:
    """The columns a table has from the start for rows of ``source``: integers as bigint, dates as timestamp.

    Decimals and maps are left to the documents, of which decimals are set aside.
    """

    def of(data_type: T.DataType) -> T.DataType | None:
        if isinstance(data_type, T.StructType):
            inner = table_type(data_type)
            return inner if inner.fields else None
        if isinstance(data_type, T.ArrayType):
            element = of(data_type.elementType)
            return T.ArrayType(element) if element is not None else None
        if isinstance(data_type, T.IntegralType):
            return T.LongType()
        if isinstance(data_type, (T.FloatType, T.DoubleType)):
            return T.DoubleType()
        if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return T.TimestampType()
        return data_type if type(data_type) in _FROM_SPARK else None

    spelled: dict[str, T.StructField] = {}
    for f in source.fields:
        kind, name = of(f.dataType), safe_name(f.name)
        if kind is not None:
            spelled.setdefault(name.lower(), T.StructField(name, kind))
    return T.StructType(list(spelled.values()))


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are worked out once a row, however often they are named afterwards.

    A projection would be merged with those above it, and its expressions repeated in each
    of their uses, until the code of a batch's check is too large to compile.
    """
    own = F.struct(*[value.alias(name) for name, value in columns.items()])
    return rows.select("*", F.inline(F.array(own)))


def read_documents(feed: DataFrame) -> DataFrame:
    """Adds the parsed document; text that is no JSON leaves it NULL."""
    return _once(feed, _doc=F.try_parse_json("full_document"))


@dataclass(frozen=True)
class Observed:
    """A field path and kind of a batch, and the ``seq`` it was first seen at.

    A None in the path stands for an array's items.
    """

    path: tuple[str | None, ...]
    kind: str
    wrapped: bool
    seq: int


def _with_form(rows: DataFrame) -> DataFrame:
    """Adds a document's form and, where the form does not tell every type, its own text.

    Documents that agree in both are judged together. A deleted row and one without a
    readable document have no form. The form is worked out once a row, and searched
    only where a quick look finds what the search is for.
    """
    raw = _once(rows, _schema=F.when(F.col("operation_type") != "delete", F.schema_of_variant("_doc")))
    schema = F.when(F.col("_schema").startswith("OBJECT<"), F.col("_schema"))
    decimal = F.when(schema.contains("DECIMAL("), F.regexp_replace(schema, DECIMAL_FORM, "DOUBLE")).otherwise(schema)
    strange = reduce(lambda a, b: a | b, [schema.contains(sign) for sign in UNCLEAR_SIGNS]) & schema.rlike(UNCLEAR_FORM)
    exact = F.when(strange, F.col("full_document")).otherwise("")
    return _once(raw, _form=decimal, _exact=exact).drop("_schema")


def forms_of(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per form: the ``seq`` it was first seen at, ``_print`` of one of its documents, and ``_odd``.

    ``_odd`` marks rows that are set aside whatever the schema: no key, not readable,
    or wider by themselves than a table. Only numbers are aggregated, so tasks hash and do not sort.
    """
    deleted = F.col("operation_type") == "delete"
    odd = F.col("document_key").isNull() | (~deleted & F.col("_form").isNull()) | _wide(width)
    return (
        rows.withColumn("_odd", F.coalesce(odd, F.lit(False)))
        .groupBy("_odd", F.when(~F.col("_odd"), F.col("_form")).alias("_form"), F.when(~F.col("_odd"), F.col("_exact")).alias("_exact"))
        .agg(F.min("seq").alias("seq"), F.min(_print()).alias("_print"))
    )


def _print() -> Column:
    """A number by which a document is found again; another of the same number is told apart by its form."""
    return F.xxhash64("full_document")


def _wide(width: int) -> Column:
    # So many fields take three characters each at least.
    long = F.length("_form") > 3 * width
    return F.coalesce(F.when(long, F.regexp_count("_form", F.lit(": ")) > width).otherwise(F.lit(False)), F.lit(False))


def _examples(feed: DataFrame, forms: DataFrame) -> DataFrame:
    """A parsed document of each form, under the form's first ``seq``: seq, _form, _exact, _doc, _members.

    One is found by its print, not by its ``seq``, which all rows of a sync share: the
    others are neither parsed again nor sorted.
    """
    wanted = forms.where("NOT _odd AND _form IS NOT NULL").select("seq", "_form", "_exact", "_print")
    near = feed.select("operation_type", "full_document").withColumn("_print", _print())
    near = near.join(wanted.select("_print").distinct(), "_print", "left_semi")
    # Equal documents are one; of others with this print each is met with its own form alone.
    own = _with_form(read_documents(near.distinct())).join(wanted, ["_print", "_form", "_exact"])
    once = own.dropDuplicates(["_form", "_exact"]).select("seq", "_form", "_exact", "_doc")
    return once.withColumn("_members", _members(F.col("_doc")))


@dataclass
class Memory:
    """What a table's writer knows of documents from earlier batches: forms that fit the schema as they are.

    A batch of known forms needs no look at its fields. Nothing is lost with it; it is learnt anew.
    """

    schema_json: str = ""
    root: Shape | None = None
    forms: set[str] = field(default_factory=set)

    def knows(self, schema: T.StructType) -> bool:
        return self.root is not None and self.schema_json == schema.json()


# Forms, and characters of them, that a writer remembers.
MEMORY_FORMS, MEMORY_CHARS = 1_000, 4_000_000


def observed_fields(documents: DataFrame, limit: int = WIDTH, levels_at_once: int = LEVELS) -> tuple[list[Observed], bool]:
    """The field paths and kinds of the documents, the first seen first, and whether there are more than ``limit``.

    Several nesting levels are one aggregation over path and kind; the driver receives
    the fields alone.
    """

    def described(rows: DataFrame) -> DataFrame:
        form = F.schema_of_variant("value")
        return (
            rows.select("seq", F.concat("path", F.array("name")).alias("path"), "value", form.alias("form"))
            .withColumn("kind", kind_of_form(F.col("form")))
            .withColumn("wrapped", F.col("form").startswith("OBJECT<") & (F.col("kind") != "object"))
            .drop("form")
            .where(F.col("kind").isNotNull())
        )

    def below(level: DataFrame) -> DataFrame:
        members = F.map_entries(_members(F.col("value")))
        items = F.transform(_items(F.col("value")), lambda v: F.struct(F.lit(None).cast("string").alias("key"), v.alias("value")))
        parts = F.when(F.col("kind") == "object", members).when(F.col("kind") == "array", items)
        return described(level.select("seq", "path", F.inline(parts).alias("name", "value")))

    level = described(
        documents.select(
            "seq", F.array().cast("array<string>").alias("path"), F.explode("_members").alias("name", "value")
        )
    )
    found: list[Observed] = []
    while True:
        levels = [level]
        for _ in range(levels_at_once - 1):
            levels.append(below(levels[-1]))
        together = levels[0].select("seq", "path", "kind", "wrapped")
        for one in levels[1:]:
            together = together.unionByName(one.select("seq", "path", "kind", "wrapped"))
        rows = (
            together.groupBy("path", "kind", "wrapped")
            .agg(F.min("seq").alias("seq"))
            .orderBy("seq", F.size("path"), "path", "kind", "wrapped")
            .limit(limit + 1)
            .collect()
        )
        found += [Observed(tuple(row.path), row.kind, row.wrapped, row.seq) for row in rows]
        if len(found) > limit:
            return found[:limit], True
        deepest = max((len(row.path) for row in rows), default=0)
        if not any(row.kind in ("object", "array") and len(row.path) == deepest for row in rows) or deepest % levels_at_once:
            return found, False
        level = below(levels[-1])


def _count(shape: Shape) -> int:
    below = [*shape.fields.values(), *([shape.element] if shape.element else [])]
    return len(shape.fields) + sum(_count(s) for s in below)


def _close(shape: Shape) -> None:
    shape.closed = True
    for below in [*shape.fields.values(), *([shape.element] if shape.element else [])]:
        _close(below)


def grow(schema: T.StructType, observed: list[Observed], width: int = WIDTH) -> Shape:
    """The registered schema widened by what a batch brought; first type wins, and so do first fields."""
    root = _shape(schema)
    room = width - _count(root)
    # Of an integer and a decimal in one array, neither of which is first, the wider counts.
    order = sorted(observed, key=lambda o: (o.seq, len(o.path), [p or "" for p in o.path], o.kind != "double", o.kind))
    for seen in order:
        parent: Shape | None = root
        for step in seen.path[:-1]:
            parent = parent and (parent.element if step is None else parent.fields.get(safe_name(step)))
        if parent is None:
            continue
        before = len(parent.fields)
        known = _register(parent, seen, room > 0)
        room -= len(parent.fields) - before
        if known is not None and known.kind == seen.kind and seen.wrapped:
            known.wrapped = True
    return root


def _register(parent: Shape, seen: Observed, room: bool) -> Shape | None:
    """Notes a name under its column, and the column's type when it is the first."""
    raw = seen.path[-1]
    if raw is None:
        if parent.kind == "array" and parent.element is None and seen.kind != "decimal128":
            parent.element = Shape(seen.kind)
        return parent.element
    if parent.kind != "object":
        return None
    name = safe_name(raw)
    spelled = {known.lower(): known for known in parent.fields}
    if spelled.get(name.lower(), name) != name:
        parent.refused.setdefault(raw, CASE_REASON)
        return None
    if name not in parent.fields and not room:
        parent.refused.setdefault(raw, WIDE_REASON)
        return None
    names = parent.raw.setdefault(name, [])
    if raw not in names:
        names.append(raw)
    if name not in parent.fields and seen.kind != "decimal128":
        parent.fields[name] = Shape(seen.kind)
    return parent.fields.get(name)


def _members(value: Column) -> Column:
    return value.try_cast("map<string,variant>")


def _items(value: Column) -> Column:
    return value.try_cast("array<variant>")


def _nothing() -> Column:
    return F.array().cast("array<string>")


# --- raw text, needed only where two names fall on one column ------------------------


def _texts(text: Column, array: bool = False) -> Column:
    """The JSON text of an object's members or an array's items."""
    return F.from_json(text, "array<string>" if array else "map<string,string>")


def _last_of(names: list[str], text: Column) -> Column:
    """Which of several names comes last in the document."""
    present = F.filter(F.json_object_keys(text), lambda k: k.isin(*names))
    return F.element_at(F.when(F.size(present) > 0, present), -1)


def _below(names: list[str], text: Column | None, child: Shape) -> Column | None:
    if text is None or not child.clashes:
        return None
    return _texts(text)[F.lit(names[0]) if len(names) == 1 else _last_of(names, text)]


# --- checking ------------------------------------------------------------------------


def _map(table: dict[str, Column]) -> Column:
    return F.create_map(*[part for name, value in table.items() for part in (F.lit(name), value)])


def _tail(column: str, want: str) -> str:
    return TYPE_REASON.format(got="\0", column=column, want=want).split("\0")[1]


def _reason(got: Column, tail: Column) -> Column:
    head = TYPE_REASON.split("{got}")[0]
    return F.when(got == "decimal128", F.lit(DECIMAL_REASON)).otherwise(F.concat(F.lit(head), got, tail))


def _takes(kind: str) -> tuple[str, ...]:
    return _TAKES.get(kind, (kind,))


def _object_problems(members: Column, text: Column | None, shape: Shape, column: str) -> Column:
    """Why an object's fields do not fit: an array of reasons, empty when they do.

    All fields are looked up in one constant table, so the expression does not
    grow with the number of columns.
    """
    takes, tails, inner = {}, {}, []
    for name, raw in shape.raw.items():
        child = shape.fields.get(name)
        label = f"{column}.{name}" if column else name
        for one in raw:
            takes[one] = F.array(*[F.lit(k) for k in (_takes(child.kind) if child else ())]).cast("array<string>")
            tails[one] = F.lit(_tail(label, child.kind if child else "unknown"))
        if child and child.kind in ("object", "array"):
            chosen = F.lit(raw[0]) if len(raw) == 1 or text is None else _last_of(raw, text)
            inner.append(_inner_problems(members[chosen], _below(raw, text, child), child, label))
    for raw, why in shape.refused.items():
        takes[raw], tails[raw] = _nothing(), F.lit(why)
    if not takes and not shape.closed:
        return _nothing()
    takes = takes or {"": _nothing()}
    kinds = F.map_entries(F.transform_values(members, lambda _, v: kind_of(v)))
    unknown = lambda e: F.lit(shape.closed) & ~F.map_contains_key(_map(takes), e["key"])
    bad = F.filter(
        kinds, lambda e: e["value"].isNotNull() & (unknown(e) | ~F.array_contains(_map(takes)[e["key"]], e["value"]))
    )
    clashing = [raw for raw in shape.raw.values() if len(raw) > 1]
    if clashing and text is not None:
        # An overwritten field is not in the result, so its type does not matter.
        kept = F.array(*[_last_of(raw, text) for raw in clashing])
        every = [name for raw in clashing for name in raw]
        bad = F.filter(bad, lambda e: ~e["key"].isin(*every) | F.array_contains(kept, e["key"]))
    refused = list(shape.refused)
    tail = _map(tails or {"": F.lit("")})
    reasons = F.transform(
        bad,
        lambda e: F.when(unknown(e), F.lit(WIDE_REASON))
        .when(e["key"].isin(*refused) if refused else F.lit(False), tail[e["key"]])
        .otherwise(_reason(e["value"], tail[e["key"]])),
    )
    return F.concat(F.coalesce(reasons, _nothing()), *inner) if inner else F.coalesce(reasons, _nothing())


def _inner_problems(value: Column, text: Column | None, shape: Shape, column: str) -> Column:
    """What is wrong below a value whose own kind is checked elsewhere."""
    if shape.kind == "object":
        return _object_problems(_members(value), text, shape, column)
    if shape.kind == "array" and shape.element is not None:
        element, items = shape.element, _items(value)
        tail = F.lit(_tail(column, element.kind))
        wrong = F.filter(items, lambda v: ~kind_of(v).isin(*_takes(element.kind)))
        reasons = F.coalesce(F.transform(wrong, lambda v: _reason(kind_of(v), tail)), _nothing())
        if element.kind not in ("object", "array"):
            return reasons
        if text is None or not element.clashes:
            below = F.transform(items, lambda v: _inner_problems(v, None, element, column))
        else:
            texts = _texts(text, array=True)
            below = F.zip_with(items, texts, lambda v, t: _inner_problems(v, t, element, column))
        return F.concat(reasons, F.coalesce(F.flatten(below), _nothing()))
    return _nothing()


# --- typing --------------------------------------------------------------------------


def _raw_type(shape: Shape) -> str:
    """The type Spark reads a value as: by its names in the documents, wrappers as they are."""
    if shape.kind == "object":
        parts = [
            "`{}`: {}".format(raw.replace("`", "``"), _raw_type(shape.fields[name]))
            for name, names in shape.raw.items()
            if name in shape.fields and shape.fields[name].spark_type() is not None
            for raw in names
        ]
        return f"struct<{', '.join(parts)}>" if parts else "variant"
    if shape.kind == "array":
        return f"array<{_raw_type(shape.element)}>"
    return "variant" if shape.wrapped else SCALARS[shape.kind].simpleString()


def _as_read(shape: Shape) -> bool:
    """Whether a value read by its raw type already is the column's value."""
    if shape.kind == "object":
        known = [name for name, child in shape.fields.items() if child.spark_type() is not None]
        plain = [name for name in shape.raw if name in known]
        return plain == known and all(shape.raw[n] == [n] and _as_read(shape.fields[n]) for n in known)
    if shape.kind == "array":
        return _as_read(shape.element)
    return not shape.wrapped


def _columns(value: Column, text: Column | None, shape: Shape) -> list[Column]:
    """An object's fields as typed columns; NULL where the batch never had the field."""
    columns = []
    for part in shape.spark_type().fields if shape.spark_type() else []:
        child, raw = shape.fields[part.name], shape.raw.get(part.name, [])
        column = F.lit(None).cast(part.dataType)
        if len(raw) == 1:
            column = _typed(value.getField(raw[0]), _below(raw, text, child), child)
        elif raw:
            last, below = _last_of(raw, text), _below(raw, text, child)
            column = F.coalesce(*[F.when(last == one, _typed(value.getField(one), below, child)) for one in raw])
        columns.append(column.alias(part.name))
    return columns


def _typed(value: Column, text: Column | None, shape: Shape) -> Column:
    """A fitting value, read by its raw type, as the column's type."""
    if _as_read(shape):
        return value
    if shape.kind == "object":
        present = value.isNotNull() if any(shape.raw.values()) else ~F.coalesce(F.is_variant_null(value), F.lit(True))
        return F.when(present, F.struct(*_columns(value, text, shape)))
    if shape.kind == "array":
        if text is None or not shape.element.clashes:
            return F.transform(value, lambda v: _typed(v, None, shape.element))
        return F.zip_with(value, _texts(text, array=True), lambda v, t: _typed(v, t, shape.element))
    return scalar(value, shape.kind)


@dataclass
class Conformed:
    """A batch under its grown schema.

    ``clean`` says that nothing can be rejected; where it is False, persist
    ``checked`` before using both halves.  ``empty`` says that there are no rows.
    """

    schema: T.StructType
    checked: DataFrame
    clean: bool
    empty: bool = False

    def setting_aside(self, rows: DataFrame) -> Conformed:
        """The batch with further rejects: seq, cluster_time, doc and reason."""
        own = {SEQ: "seq", AT: "cluster_time", _TEXT: "doc", _REASON: "reason"}
        named = rows.select(*[F.col(name).alias(column) for column, name in own.items()])
        return Conformed(self.schema, self.checked.unionByName(named, allowMissingColumns=True), False)

    @property
    def accepted(self) -> DataFrame:
        return self.checked.where(F.col(_REASON).isNull()).drop(_REASON, _TEXT)

    @property
    def rejected(self) -> DataFrame:
        return self.checked.where(F.col(_REASON).isNotNull()).select(
            F.col(SEQ).alias("seq"), F.col(AT).alias("cluster_time"), F.col(_TEXT).alias("doc"), F.col(_REASON).alias("reason")
        )


def conform(
    feed: DataFrame,
    schema: T.StructType | None = None,
    missing_post_image: str = "fail",
    width: int = WIDTH,
    memory: Memory | None = None,
) -> Conformed:
    """Types a batch of kept feed events against a schema that grows with it.

    ``accepted`` has ``_id``, ``__seq``, ``__at``, ``__alive`` and the document
    columns; ``rejected`` has seq, cluster_time, doc (the text as it came) and
    reasons.  ``missing_post_image`` is ``fail`` or ``dlq``.

    Documents of one form are judged once, by one of them; where a form does not tell
    every type, each document is. Fields are registered in the order in which they were
    first seen until the table is ``width`` fields wide; a document with further fields,
    or with more fields than that itself, is set aside. ``memory`` carries the forms
    that fit from one batch to the next.
    """
    schema = schema or T.StructType([])
    rows = _with_form(read_documents(feed))
    # Kept for the looks at them that follow; a lost part is simply worked out again.
    forms = forms_of(rows, width).persist()
    try:
        seen = forms.select("_odd", "_form", (F.coalesce("_exact", F.lit("")) != "").alias("_unclear")).limit(MEMORY_FORMS + 1).collect()
        few = len(seen) <= MEMORY_FORMS
        if few and memory is not None and memory.knows(schema):
            if all(not r._odd and not r._unclear and (r._form is None or r._form in memory.forms) for r in seen):
                batch = _typed_batch(rows, memory.root, F.lit(None).cast("string"), None, missing_post_image, width, True)
                batch.empty = not seen
                return batch
        # Forms say how deep their documents are, so levels that none has need no look.
        depth = max([(r._form or "").count("<") for r in seen], default=1) if few else LEVELS
        documents = _examples(feed, forms).persist()
        try:
            batch, root = _conformed(rows, forms, documents, schema, missing_post_image, width, max(1, min(LEVELS, depth)))
        finally:
            documents.unpersist()
        if memory is not None and batch.clean and not root.clashes and not root.closed:
            _remember(memory, batch.schema, root, seen)
        batch.empty = not seen
        return batch
    finally:
        forms.unpersist()


def _remember(memory: Memory, schema: T.StructType, root: Shape, seen: list) -> None:
    """Notes the forms of a batch all of whose documents fitted. Forms whose types do not tell all are not known."""
    if _any_wrapped(root) or any(r._unclear for r in seen) or len(seen) > MEMORY_FORMS:
        return
    # What fitted the schema before fits the grown one, but its names are no part of this batch's shape.
    forms = {r._form for r in seen if r._form}
    if memory.root is not None and memory.schema_json == schema.json() and _names(memory.root) == _names(root):
        forms |= memory.forms
    if len(forms) <= MEMORY_FORMS and sum(map(len, forms)) <= MEMORY_CHARS:
        memory.schema_json, memory.root, memory.forms = schema.json(), root, forms


def _any_wrapped(shape: Shape) -> bool:
    return shape.wrapped or any(_any_wrapped(s) for s in [*shape.fields.values(), *([shape.element] if shape.element else [])])


def _names(shape: Shape) -> tuple:
    """All raw names of a shape and below."""
    inner = _names(shape.element) if shape.element else ()
    return (tuple((n, tuple(shape.raw.get(n, ())), _names(c)) for n, c in shape.fields.items()), inner)


def _conformed(
    rows: DataFrame, forms: DataFrame, documents: DataFrame, schema: T.StructType, missing_post_image: str, width: int, levels: int
) -> tuple[Conformed, Shape]:
    observed, more = observed_fields(documents, 2 * width, levels)
    root = grow(schema, observed, width)
    if more:
        _close(root)
    for own in OWN:
        for name in [n for n in root.fields if n.lower() == own]:
            del root.fields[name]
            root.refused.update({raw: RESERVED_REASON for raw in root.raw.pop(name, [])})
    root.raw.pop(KEY, None)
    root.fields.pop(KEY, None)
    order_text = F.col("full_document") if root.clashes else None
    if root.clashes:
        rows = rows.withColumn("_members", _members(F.col("_doc")))
    checked, misfit, clean = _misfits(rows, forms, documents, root, order_text)
    unread = _unread(_members(F.col("_doc")), root)
    # All parts are looked at side by side; ``take`` would begin with one.
    clean = clean and (unread is None or not rows.where(unread).limit(1).count())
    return _typed_batch(checked, root, misfit, unread, missing_post_image, width, clean), root


def _typed_batch(
    checked: DataFrame, root: Shape, misfit: Column, unread: Column | None, missing_post_image: str, width: int, clean: bool
) -> Conformed:
    """The rows as columns of the shape, with the reason why one does not fit."""
    data = root.spark_type() or T.StructType([])
    text, deleted = F.col("full_document"), F.col("operation_type") == "delete"
    order_text = text if root.clashes else None
    no_document = F.when(
        lacks_post_image(),
        F.raise_error(F.lit(MISSING_POST_IMAGE)).cast("string")
        if missing_post_image == "fail"
        else F.lit(MISSING_POST_IMAGE),
    ).otherwise(F.lit(UNREADABLE_REASON))
    reason = (
        F.when(F.col("document_key").isNull(), NO_KEY_REASON)
        .when(deleted, F.lit(None).cast("string"))
        .when(F.col("_form").isNull(), no_document)
        .when(_wide(width), WIDE_REASON)
        .otherwise(misfit if unread is None else F.coalesce(misfit, F.when(unread, UNREAD_VALUE_REASON)))
    )
    checked = checked.withColumn(_REASON, F.lit(None).cast("string")) if clean else _once(checked, **{_REASON: reason})
    raw_type = _raw_type(root)
    if raw_type != "variant":
        checked = _once(checked, _raw=F.try_variant_get("_doc", "$", raw_type))
    typed = checked.select(
        F.col("document_key").alias(KEY),
        F.col("seq").alias(SEQ),
        F.col("cluster_time").alias(AT),
        (~deleted).alias(ALIVE),
        *_columns(F.col("_raw"), order_text, root),
        F.when(F.col(_REASON).isNotNull(), text).alias(_TEXT),
        _REASON,
    )
    return Conformed(data, typed, clean)


def _unread(members: Column, shape: Shape) -> Column | None:
    """Whether a value below came wrapped, is of its column's kind, and yet has no reading; None where none is wrapped."""
    found = [
        _unread_value(members[F.lit(raw)], shape.fields[name])
        for name, names in shape.raw.items()
        if name in shape.fields
        for raw in names
    ]
    found = [part for part in found if part is not None]
    return reduce(lambda a, b: a | b, found) if found else None


def _unread_value(value: Column, shape: Shape) -> Column | None:
    if shape.kind == "object":
        return _unread(_members(value), shape)
    if shape.kind == "array":
        if shape.element is None or _unread_value(value, shape.element) is None:
            return None
        return F.coalesce(F.exists(_items(value), lambda item: _unread_value(item, shape.element)), F.lit(False))
    if not shape.wrapped:
        return None
    came = F.coalesce(F.schema_of_variant(value).startswith("OBJECT<"), F.lit(False))
    return came & (kind_of(value) == shape.kind) & scalar(value, shape.kind).isNull()


def _misfits(
    rows: DataFrame, forms: DataFrame, documents: DataFrame, root: Shape, text: Column | None
) -> tuple[DataFrame, Column, bool]:
    """The rows, why a row's document does not fit (or NULL), and whether all rows fit."""
    problems = _object_problems(F.col("_members"), text, root, "")
    by_value = F.when(F.size(problems) > 0, F.array_join(F.array_distinct(problems), "; "))
    if root.clashes:
        # Which of two names counts depends on their order, which a form does not tell.
        return rows, by_value, False
    # Kept as a table, so that what follows neither judges the forms again nor needs their rows in memory.
    bad = documents.withColumn("_why", by_value).where("_why IS NOT NULL").select("_form", "_exact", "_why")
    odd = forms.where("_odd").select(F.lit(None).cast("string").alias("_form"), F.lit("").alias("_exact"), F.lit("").alias("_why"))
    counted, path = Observation(), shared_dir(rows.sparkSession, "forms")
    bad.unionByName(odd).observe(counted, F.count(F.lit(1)).alias("n")).write.parquet(path)
    if not counted.get["n"]:
        return rows, F.lit(None).cast("string"), True
    known = rows.sparkSession.read.schema("_form string, _exact string, _why string").parquet(path)
    return rows.join(known, ["_form", "_exact"], "left"), F.col("_why"), False
