"""Line dedup: lines found in many documents go from every document.

Lines become hashes of their keys (blanks stripped, A-Z lower-cased), one for each
document and key, and the hashes' documents are counted with partial sums, so a line
in a third of all documents costs one row per task. The hashes that pass the
threshold meet the (document, hash) pairs in a join that adaptive execution splits.
Only then does each text move once, to its own list of dropped hashes, and is put
together again from the lines that stay, by position.

Defined results: a NULL or empty text is one empty line; empty keys are never
dropped. Repeated rows count as documents of their own. A document that loses every
line keeps an empty text. Rows of NULL id keep apart from other ids and share their
lines' verdicts. An empty table gives no rows. All columns of the input pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.native import BLANKS, field, hash128, lower_az, packed, quoted

MIN_CHARS, MIN_DOCS = 1, 10


def _keys(text: Column) -> Column:
    """The hash of every line's key by position; NULL for keys too short to count."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.transform(lines, lambda line: _key(line))


def _key(line: Column) -> Column:
    key = F.btrim(line, F.lit(BLANKS))
    return F.when(F.char_length(key) >= MIN_CHARS, hash128(lower_az(key)))


def frequent_lines(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """The hashes of the keys found in ``min_docs`` documents or more."""
    each = docs.select(F.explode(F.array_distinct(_keys(F.col(quoted(text))))).alias("hash")).where("hash IS NOT NULL")
    return each.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("hash")


def split_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """``row`` (all columns as a struct), and its ``lines`` and those ``kept``, by position."""
    pairs = docs.select(F.col(quoted(doc_id)).alias("id"), F.explode(F.array_distinct(_keys(F.col(quoted(text))))).alias("hash"))
    hits = pairs.where("hash IS NOT NULL").join(frequent_lines(docs, text, min_docs), "hash")
    # One list per document, no longer than its own lines.
    drops = hits.groupBy("id").agg(F.collect_set("hash").alias("drop"))
    joined = packed(docs).join(drops, field(doc_id).eqNullSafe(F.col("id")), "left")
    joined = joined.select("row", "drop", F.split(F.coalesce(field(text), F.lit("")), "\n", -1).alias("lines"))
    stay = F.filter("lines", lambda line: ~F.coalesce(F.array_contains(F.col("drop"), _key(line)), F.lit(False)))
    return joined.select("row", "lines", F.when(F.col("drop").isNull(), F.col("lines")).otherwise(stay).alias("kept"))


def without_frequent_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """The same columns, each text without its frequent lines (a NULL text stays NULL)."""
    done = split_lines(docs, doc_id=doc_id, text=text, min_docs=min_docs)
    left = F.when(field(text).isNotNull(), F.array_join("kept", "\n")).alias(text)
    return done.select(*[left if c == text else field(c).alias(c) for c in docs.columns])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return split_lines(docs).select(
        field("doc_id").alias("doc_id"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"),
    )


ORACLE = r"""
WITH l AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), e AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM l
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e
), f AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), m AS (
  SELECT k.*, f.key IS NOT NULL AS dropped FROM k LEFT JOIN f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
