"""Quality rules: simple limits, then robust multivariate outliers per language and source.

Each text becomes counts, and the counts a vector of transformed statistics (``FEATURES``).
Per group of language and source the minimum covariance determinant estimate is found by
concentration steps over all documents: distances from the present estimate are counted in
fine bins together with the sums and cross sums of their vectors, so one aggregation tells
which bins hold the nearest ``COVER`` of the group and what their mean and covariance are.
There are three starts: medians with quartile ranges, medians with equal spreads, and the
plain mean and covariance of all. After ``TRIED`` steps the one with the least determinant goes
on, until no group's determinant falls any more. A group with fewer rows (with
words) than ``MIN_ROWS`` uses its language's estimate, or that of all; to these every row of
the language, or of the table, counts, also those of groups large enough for their own.
A document whose squared Mahalanobis distance exceeds the chi-square quantile ``1 - TAIL``
is rejected. A whole table of fewer rows than ``MIN_ROWS`` has only itself to go by.

No statistic is the same for most documents: marks stand in every prose, symbols among them,
and repeats add to the rate at which words come again anyway. Each text counts as if ``PRIOR``
plain words stood before it, so that short ones do not vary more than long ones. Floors of the
spread (``FEATURES``) serve directions in which a group does not vary at all.

Statistics are whole multiples of 1/65536, so their sums are exact and every run, however
partitioned, gives the same verdicts.
Groups are partial sums before any shuffle: a source of a third of all rows costs one row per
task and bin, at each level.

Defined results: a very long text is one row of counts; a very long word is a word. NULL and empty texts, and texts of blanks, have no words and fail. NULL
languages and sources are groups of their own. Repeated rows count each. An empty table
gives no rows. Other columns never meet the operator's own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import tokens as T
from tidemark.llm.graph import kept
from tidemark.llm.native import field, quoted, without

COVER, MIN_ROWS, TRIED, STEPS, TAIL = 0.75, 200, 2, 12, 1e-5
#: Statistic and the least standard deviation it is held to, in directions in which a group's rows are all alike.
FEATURES = (
    ("log_word_length", 0.006),
    ("root_short_word_share", 0.006),
    ("root_mark_share", 0.006),
    ("root_capital_share", 0.006),
    ("repetition", 0.0015),
)
#: The plain words that every text counts as having before its own, for lengths and shares and for repetition, and what
#: they hold: code points, short words, marks, capitals.
PRIOR, PRIOR_REPEATS = 20, 50
PRIOR_CHARS, PRIOR_SHORT, PRIOR_MARKS, PRIOR_CAPITALS = 100, 8, 3.0, 1.6
#: Code points of a short word at most.
SHORT = 3
#: How the logarithm of words by distinct words grows with their number, and what a repeated window or line adds to it.
GROWTH, WINDOW_WEIGHT, LINE_WEIGHT = 0.45, 0.025, 0.0125
SCALE = 65536
#: Values are counted in steps of this many for the quartiles; an estimate is final once its determinant's logarithm falls by no more than that.
_STEP, ENOUGH = 16, 1e-4
_D = len(FEATURES)
_FLOOR = np.array([f for _, f in FEATURES])
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_capitals bigint, n_short bigint, n_distinct bigint, n_marks bigint"


def text_counts(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The columns of ``_COUNTS`` for every text of a chunk."""

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(flags))
        return np.diff(total[bounds])

    starts, ends, first = T.words(data, bounds)
    names = T.word_names(data, starts, ends)
    inside = ~T._BLANK[data]
    # Lines: from a text's start or a line feed to the next.
    feeds = np.flatnonzero(data == 10)
    line_start = np.union1d(bounds[:-1][np.diff(bounds) > 0], feeds + 1)
    line_start = line_start[line_start < len(data)]
    line_end = np.minimum(np.append(line_start[1:], len(data)), np.append(feeds, len(data))[np.searchsorted(feeds, line_start)])
    has_word = np.append(0, np.cumsum(inside))
    full = has_word[line_end] > has_word[line_start]
    text = np.searchsorted(bounds, line_start[full], "right") - 1
    prints = T.names_of(data, line_start[full], line_end[full])
    order = np.lexsort((prints, text))
    again = np.append(False, (prints[order][1:] == prints[order][:-1]) & (text[order][1:] == text[order][:-1]))[: len(order)]
    repeated = np.bincount(text[order][again], minlength=len(bounds) - 1)
    lines = np.bincount(text, minlength=len(bounds) - 1)
    at, grams = T.windows(names, first, 5)
    owner = np.searchsorted(first, at, "right").astype(np.uint64)
    _, kind, times = np.unique(T.mix(grams ^ T.mix(owner)), return_inverse=True, return_counts=True)
    edge = np.zeros(len(names) + 1, np.int64)
    twice = at[times[kind] > 1]
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + 5, -1)
    covered = np.append(0, np.cumsum(np.cumsum(edge)[:-1] > 0))
    points = np.append(0, np.cumsum(inside & ((data & 0xC0) != 0x80)))
    short = np.append(0, np.cumsum(points[ends] - points[starts] <= SHORT))
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    _, once = np.unique(T.mix(names ^ T.mix(of.astype(np.uint64))), return_index=True)
    return [
        np.diff(first), per_text(inside & ((data & 0xC0) != 0x80)), per_text(_SYMBOL[data]), repeated,
        np.diff(covered[first]), lines, per_text((data >= 65) & (data <= 90)),
        np.diff(short[first]), np.bincount(of[once], minlength=len(bounds) - 1), per_text(_MARK[data]),
    ]


def counted(docs: DataFrame, doc_id: str, text: str, lang: str, source: str) -> DataFrame:
    """doc_id, key (of the row), lang, source and the counts of every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, bounds in T.chunks(batch.column("text")):
                n = len(bounds) - 1
                rest = [batch.column(c).slice(row, n) for c in ("doc_id", "key", "lang", "source")]
                yield pa.RecordBatch.from_arrays(
                    rest + [pa.array(x, pa.int64()) for x in text_counts(data, bounds)],
                    names=["doc_id", "key", "lang", "source"] + [c.split()[0] for c in _COUNTS.split(", ")],
                )

    column = lambda c: F.col(quoted(c))
    rows = docs.select(
        column(doc_id).alias("doc_id"), row_key(column(text), column(lang), column(source)).alias("key"),
        column(lang).cast("string").alias("lang"), column(source).cast("string").alias("source"), column(text).alias("text"),
    )
    return rows.mapInArrow(count, f"doc_id bigint, key bigint, lang string, source string, {_COUNTS}")


def row_key(*columns: Column) -> Column:
    return F.xxhash64(*columns)


def _statistics() -> Column:
    words, chars = F.col("n_words") + PRIOR, F.col("word_chars") + PRIOR_CHARS
    many, share = F.col("n_words") + PRIOR_REPEATS, lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    values = [
        F.log(chars / words), F.sqrt((F.col("n_short") + PRIOR_SHORT) / words),
        F.sqrt((F.col("n_marks") + PRIOR_MARKS) / chars), F.sqrt((F.col("n_capitals") + PRIOR_CAPITALS) / chars),
        F.log(many / (F.col("n_distinct") + PRIOR_REPEATS)) / F.pow(many, F.lit(GROWTH))
        + WINDOW_WEIGHT * share("n_repeat_words", "n_words") + LINE_WEIGHT * share("n_dup_lines", "n_lines"),
    ]
    return F.array(*[F.round(v * SCALE).cast("long") for v in values])


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _chi2_cdf(x: float, d: int) -> float:
    a, x = d / 2, x / 2
    term = total = 1 / a
    for k in range(1, 400):
        term *= x / (a + k)
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a)) if x > 0 else 0.0


def _chi2_quantile(p: float, d: int) -> float:
    low, high = 0.0, 400.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi2_cdf(middle, d) < p else (low, middle)
    return high


def _estimate(mean: np.ndarray, covariance: np.ndarray, factor: float) -> dict:
    """Centre, precision and logarithm of the determinant. In units of the floors no direction's spread is below one, so any few rows have an inverse."""
    spread, axes = np.linalg.eigh(covariance * factor / np.outer(_FLOOR, _FLOOR))
    spread = np.maximum(spread, 1.0)
    precision = (axes / spread) @ axes.T / np.outer(_FLOOR, _FLOOR)
    return {"centre": mean.tolist(), "precision": precision.reshape(-1).tolist(), "spread": float(np.log(spread).sum())}


def _starts(rows: pd.DataFrame) -> pd.DataFrame:
    """A group's first estimates from counts of each statistic's values (in steps of ``_STEP``)."""
    centre, spread = np.zeros(_D), np.zeros(_D)
    for k, own in rows.groupby("k"):
        own = own.sort_values("bin")
        total = own["n"].cumsum().to_numpy()
        q = [own["bin"].to_numpy()[np.searchsorted(total, total[-1] * p)] * _STEP / SCALE for p in (0.25, 0.5, 0.75)]
        centre[k], spread[k] = q[1], (q[2] - q[0]) / 1.349
    plain = _estimate(centre, np.zeros((_D, _D)), 1.0)
    # Without a precision all distances are 0, so the first step takes the mean and covariance of all.
    found = [_estimate(centre, np.diag(spread**2), 1.0), plain, plain | {"precision": [0.0] * _D * _D}]
    return pd.DataFrame([{"group": rows["group"].iloc[0], "start": i, **e} for i, e in enumerate(found)])


def _concentrated(rows: pd.DataFrame) -> pd.DataFrame:
    """A group's next estimate from the sums of its nearest rows."""
    rows = rows.sort_values("bin")
    n = rows["n"].cumsum().to_numpy()
    last = int(np.searchsorted(n, math.ceil(COVER * n[-1])))
    held = float(n[last])
    sums = np.array(rows["sums"].to_list(), np.float64)[: last + 1].sum(axis=0) / SCALE
    cross = np.array(rows["cross"].to_list(), np.float64)[: last + 1].sum(axis=0) / SCALE**2
    mean = sums / held
    matrix = np.zeros((_D, _D))
    matrix[np.triu_indices(_D)] = cross / held
    matrix = matrix + np.triu(matrix, 1).T - np.outer(mean, mean)
    share = min(held / n[-1], 0.999999)
    factor = share / _chi2_cdf(_chi2_quantile(share, _D), _D + 2)
    return pd.DataFrame([{"group": rows["group"].iloc[0], "start": rows["start"].iloc[0], **_estimate(mean, matrix, factor)}])


_PARAMS = "group string, start int, centre array<double>, precision array<double>, spread double"


def _distance() -> Column:
    x = [F.get("x", F.lit(i)) / SCALE - F.get("centre", F.lit(i)) for i in range(_D)]
    return sum((F.get("precision", F.lit(i * _D + j)) * x[i] * x[j] for i in range(_D) for j in range(_D)), F.lit(0.0))


def _name(level: int, *columns: str) -> Column:
    return F.to_json(F.struct(F.lit(level).alias("of"), *columns))


def _grouped(rows: DataFrame) -> DataFrame:
    """``group``, by which a row is judged: its language and source, or its language, or all, whichever has enough
    rows with words first. ``groups``: all those by which any row is judged and to which this one belongs."""
    spark = rows.sparkSession
    rows = rows.withColumn("__pair", _name(2, "lang", "source"))
    pairs = rows.groupBy("__pair", _name(1, "lang").alias("__lang")).agg(F.count(F.when(F.col("n_words") > 0, 1)).alias("n"))
    pairs = kept(spark, pairs, "pairs")
    langs = pairs.groupBy(F.col("__lang").alias("__of")).agg(F.sum("n").alias("in_lang"), F.min("n").alias("least"))
    whole = langs.agg((F.min("in_lang") < MIN_ROWS).alias("any_small"))
    pairs = pairs.join(langs, F.col("__lang") == F.col("__of")).crossJoin(F.broadcast(whole))
    own, lang, every = F.col("n") >= MIN_ROWS, F.col("in_lang") >= MIN_ROWS, F.lit("all")
    asked = F.array(
        F.when(own, F.col("__pair")), F.when(lang & (F.col("least") < MIN_ROWS), F.col("__lang")), F.when(F.col("any_small"), every),
    )
    pairs = pairs.select(
        F.col("__pair").alias("__p"), F.when(own, F.col("__pair")).when(lang, F.col("__lang")).otherwise(every).alias("group"),
        F.array_compact(asked).alias("groups"),
    )
    return rows.join(pairs, F.col("__pair") == F.col("__p")).drop("__pair", "__p")


def _step(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Every estimate after one concentration step over all rows of its group."""
    pairs = [(i, j) for i in range(_D) for j in range(i, _D)]
    near = rows.select(F.explode("groups").alias("group"), "x").join(params, "group")
    near = near.select("group", "start", "x", F.floor(16 * F.log2(1 + F.greatest(_distance(), F.lit(0.0)))).alias("bin"))
    value = lambda i: F.get("x", F.lit(i)).cast("decimal(19,0)")
    sums = near.groupBy("group", "start", "bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(value(i)).cast("double") for i in range(_D)]).alias("sums"),
        F.array(*[F.sum(value(i) * value(j)).cast("double") for i, j in pairs]).alias("cross"),
    )
    return sums.groupBy("group", "start").applyInPandas(_concentrated, _PARAMS)


def estimates(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """One row per group: the centre and the precision matrix of its estimate, to which each row of it counts."""
    parts = rows.select("groups", F.posexplode("x").alias("k", "v")).groupBy("groups", "k", (F.floor(F.col("v") / _STEP)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    parts = parts.select(F.explode("groups").alias("group"), "k", "bin", "n").groupBy("group", "k", "bin").agg(F.sum("n").alias("n"))
    params = kept(spark, parts.groupBy("group").applyInPandas(_starts, _PARAMS), "estimates")
    for k in range(STEPS):
        after = _step(rows, params)
        if k == TRIED - 1:
            after = after.groupBy("group").agg(F.min_by(F.struct("start", "centre", "precision", "spread"), F.struct("spread", "start")).alias("best")).select("group", "best.*")
        after = kept(spark, after, "estimates")
        if k >= TRIED:
            before = params.select("group", F.col("spread").alias("was"))
            if after.join(before, "group").where(F.col("spread") < F.col("was") - ENOUGH).isEmpty():
                return after
        params = after
    return params


def judged(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", tail: float = TAIL) -> DataFrame:
    """Per row: doc_id, key, the counts, base_failed, distance (squared, from the group's estimate) and kept."""
    spark = docs.sparkSession
    rows = kept(spark, counted(docs, doc_id, text, lang, source), "counts").withColumn("x", _statistics())
    rows = kept(spark, _grouped(rows), "statistics")
    params = estimates(spark, rows.where("n_words > 0"))
    found = rows.join(params, "group", "left").withColumn("distance", F.coalesce(_distance(), F.lit(0.0))).withColumn("base_failed", base_failed())
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= _chi2_quantile(1 - tail, _D)))


def without_rejected(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that pass, all columns. Texts do not move: a filter of the rejected rows' keys lets the others through where they are."""
    found = judged(docs, doc_id=doc_id, text=text, lang=lang, source=source).where("NOT kept")
    gone = kept(docs.sparkSession, found.select(F.struct("doc_id", F.col("key").alias("of")).alias("key")), "rejected")
    return without(docs, F.struct(field(doc_id).alias("doc_id"), row_key(field(text), field(lang), field(source)).alias("of")), gone)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
