"""Digests of buckets: equal whatever the order, different with any field, and only unequal buckets read again."""

from pyspark.sql import functions as F

from tidemark.operators.changes import reconcile, reconcile_unequal
from tidemark.operators.convergence import content_convergence, look, preflight_checks, preflight_verdict
from tidemark.operators.digests import digest_tree, unequal_buckets
from tidemark.plans.mirror import Mirror
from tidemark.session import shared_dir


def rows_of(spark, n=300):
    return spark.range(n).selectExpr(
        "concat('k', id) as `_id`",
        "if(id % 7 = 0, null, id) as k",
        "timestamp_micros(id) as t",
        "named_struct('a', string(id), 'b', cast(null as string)) as s",
    )


def test_trees_tell_rows_apart(spark):
    rows = rows_of(spark)
    tree = digest_tree(rows, buckets=64, fan=4)
    assert tree.where("level = 0").count() == 1 and tree.where("level = 0").first().rows == 300
    assert unequal_buckets(tree, digest_tree(rows.repartition(7).orderBy(F.desc("k")), buckets=64, fan=4), 64, 4) == []
    one = F.col("_id") == "k7"
    others = {
        "a null for a value": rows.withColumn("k", F.when(one, 0).otherwise(F.col("k"))),
        "a microsecond": rows.withColumn("t", F.when(one, F.timestamp_micros(F.lit(8))).otherwise(F.col("t"))),
        "a null that moves": rows.withColumn("s", F.when(one, F.struct(F.lit(None).cast("string").alias("a"), F.lit("7").alias("b"))).otherwise(F.col("s"))),
        "a repeated row": rows.unionByName(rows.where(one)),
        "a lost row": rows.where(~one),
    }
    for name, other in others.items():
        assert len(unequal_buckets(tree, digest_tree(other, buckets=64, fan=4), 64, 4)) == 1, name
    twice = rows.where(one).unionByName(rows.where(one))
    swapped = rows.where("`_id` = 'k8'").unionByName(rows.where("`_id` = 'k8'"))
    assert unequal_buckets(digest_tree(twice, buckets=1), digest_tree(swapped, buckets=1), 1) == [0]


def test_empty_tables_and_null_keys(spark):
    none = rows_of(spark, 0)
    assert unequal_buckets(digest_tree(none), digest_tree(none)) == []
    assert unequal_buckets(digest_tree(none), digest_tree(rows_of(spark, 1))) != []
    unnamed = spark.sql("select cast(null as string) as `_id`, 1 as k")
    assert unequal_buckets(digest_tree(unnamed), digest_tree(unnamed)) == []
    assert content_convergence(none, none).first().estado == "convergido"


def test_unequal_buckets_hold_every_difference(spark):
    rows = rows_of(spark).drop("t", "s")
    other = rows.where("`_id` <> 'k3'").withColumn("k", F.when(F.col("k") % 50 == 1, -1).otherwise(F.col("k")))
    other = other.unionByName(spark.sql("select 'new' as `_id`, 5L as k"))
    whole = {tuple(r) for r in reconcile(other, rows).where("action <> 'noop'").collect()}
    assert {tuple(r) for r in reconcile_unequal(other, rows, buckets=32).collect()} == whole and len(whole) == 8
    found = content_convergence(rows, other).first()
    assert (found.origem_total, found.lake_total, found.estado, found.faltando, found.sobrando, found.diferentes) == (300, 300, "divergente", 1, 1, 6)


def test_a_table_opens_only_unequal_partitions(spark):
    source = spark.range(200).selectExpr("concat('k', id) as `_id`", "double(id) as amount")
    mirror = Mirror(spark, shared_dir(spark, "digests-test"), buckets=16)
    mirror.initial_sync(source)
    assert mirror.differences(source).count() == 0
    raised = source.withColumn("amount", F.when(F.col("_id") == "k42", 0.5).otherwise(F.col("amount")))
    assert [tuple(r) for r in mirror.differences(raised).collect()] == [("k42", "replace", 0.5)]
    wider = raised.withColumn("note", F.when(F.col("_id") == "k5", "x"))
    assert {(r._id, r.action, r.note) for r in mirror.differences(wider).collect()} == {("k42", "replace", None), ("k5", "replace", "x")}
    chosen = unequal_buckets(digest_tree(source, buckets=16), digest_tree(raised, buckets=16), 16)
    read = mirror._base_rows(mirror._tail(None), chosen).select(F.input_file_name().alias("f")).distinct().collect()
    assert len(chosen) == 1 and len({r.f.rsplit("/", 2)[-2] for r in read}) == 1


def test_preflight_opens_what_it_reports(spark, make_feed):
    empty = spark.createDataFrame([], "doc string")
    fine = make_feed((1, "insert", "a", "{}"))

    def gone():
        return spark.read.parquet("/no/such/table")

    def lost():
        raise ConnectionError("no answer from mongodb+srv://u:p@cluster0.x.mongodb.net")

    def rows(*parts):
        checks = preflight_checks(spark, *parts)
        return [(r.item, r.estado) for r in checks.collect()], preflight_verdict(checks).first()

    found, verdict = rows(gone, lambda: empty, lambda: fine)
    assert found == [("source", "falha"), ("dead-letter queue", "ok"), ("lake", "ok")] and verdict.modo == "com_falha"
    found, verdict = rows(lost, empty, fine)
    assert found == [("source", "falha")] and verdict.modo == "com_falha"
    found, verdict = rows(fine, empty, gone)
    assert found[-1] == ("lake", "alerta") and verdict.modo == "somente_mongodb" and verdict.ok
    found, verdict = rows(fine, gone, fine)
    assert ("dead-letter queue", "falha") in found and not verdict.ok
    assert look(lost)[0] is None and "cluster0" not in preflight_checks(spark, lost, empty, fine).first().detalhe
