"""Names, types, schema growth and the dead-letter split."""

import json

import pytest
from pyspark.sql import functions as F
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import types as T

from tidemark.functions import names
from tidemark.operators import conform as conform_module
from tidemark.functions.documents import encode_document
from tidemark.operators.conform import (
    _examples,
    _with_form,
    conform,
    forms_of,
    observed_fields,
    read_documents,
)

TYPE_REASON = "Unexpected BSON type of string for iceberg column name amount of type double"


def accepted(result):
    return {r["_id"]: r.asDict(recursive=True) for r in result.accepted.collect()}


def rejected(result):
    return {r.seq: r.reason for r in result.rejected.collect()}


def test_drift_set(make_feed):
    result = conform(
        make_feed(
            (1, "insert", "A", '{"_id":"A","amount":10.0,"status":"ENTREGUE"}'),
            (2, "insert", "B", '{"_id":"B","amount":"20.5","status":"ENTREGUE"}'),
            (3, "insert", "C", '{"_id":"C","amount":{"$numberDecimal":"30.25"},"status":"NOVO"}'),
            (4, "insert", "D", '{"_id":"D","amount":null,"fraudScore":0.9}'),
            (5, "insert", "E", '{"_id":"E","amount":"abc"}'),
        )
    )
    assert result.schema.simpleString() == "struct<amount:double,status:string,fraudScore:double>"
    rows = accepted(result)
    assert set(rows) == {"A", "D"}
    assert rows["A"]["fraudScore"] is None and rows["D"]["fraudScore"] == 0.9 and rows["D"]["amount"] is None
    assert rejected(result) == {2: TYPE_REASON, 3: "Decimal128", 5: TYPE_REASON}


def test_names_and_last_of_two_clashing_names(make_feed):
    result = conform(
        make_feed(
            (1, "insert", "1", '{"a.b":1,"nested":{"x.y":1},"items":[{"$q":2}],"meta.origem":"s"}'),
            (2, "insert", "2", '{"a_b":5,"a.b":6}'),
            (3, "insert", "3", '{"a.b":6,"a_b":5}'),
            (4, "insert", "4", '{"nested":{"x_y":3,"x.y":4},"items":[{"$q":7,"_q":8},{"_q":9,"$q":10}]}'),
        )
    )
    rows = accepted(result)
    assert rows["1"]["a_b"] == 1 and rows["1"]["nested"] == {"x_y": 1}
    assert rows["1"]["items"] == [{"_q": 2}] and rows["1"]["meta_origem"] == "s"
    assert rows["2"]["a_b"] == 6 and rows["3"]["a_b"] == 5
    assert rows["4"]["nested"] == {"x_y": 4} and rows["4"]["items"] == [{"_q": 8}, {"_q": 10}]


def test_unusual_names_stay(make_feed):
    doc = '{"cliente\\u200bzw":1,"\\u05e9\\u05dc\\u05d5\\u05dd":"rtl","emoji\\ud83e\\uddca":true,"q`t":2,"order":3,"a b":4}'
    rows = accepted(conform(make_feed((1, "insert", "U1", doc))))["U1"]
    assert rows["cliente​zw"] == 1 and rows["שלום"] == "rtl" and rows["emoji\U0001f9ca"] is True
    assert rows["q`t"] == 2 and rows["order"] == 3 and rows["a b"] == 4


def test_wrapped_values_are_typed_before_names_change(make_feed):
    doc = (
        '{"d":{"$date":"2026-01-01T00:00:00Z"},"m":{"$date":{"$numberLong":"1000"}},"o":{"$oid":"64ab"},'
        '"b":{"$binary":{"base64":"AQI=","subType":"00"}},"l":{"$numberLong":"5"},"n":[{"w":{"$date":"2026-01-02T00:00:00Z"}}]}'
    )
    result = conform(make_feed((1, "insert", "1", doc), (2, "insert", "2", '{"l":7,"o":"plain","n":[{"w":null}]}')))
    rows = accepted(result)
    assert str(rows["1"]["d"]).startswith("2026-01-01") and str(rows["1"]["m"]).startswith("1970-01-01 00:00:01")
    assert rows["1"]["o"] == "64ab" and bytes(rows["1"]["b"]) == b"\x01\x02" and rows["1"]["l"] == 5
    assert str(rows["1"]["n"][0]["w"]).startswith("2026-01-02")
    assert rows["2"]["l"] == 7 and rows["2"]["o"] == "plain" and rows["2"]["n"] == [{"w": None}]


def test_first_type_wins_and_integers_widen(make_feed):
    known = T.StructType([T.StructField("amount", T.DoubleType()), T.StructField("gone", T.StringType())])
    result = conform(make_feed((1, "insert", "1", '{"amount":3}'), (2, "insert", "2", '{"n":1}'), (3, "insert", "3", '{"n":1.5}')), known)
    rows = accepted(result)
    assert rows["1"]["amount"] == 3.0 and rows["1"]["gone"] is None
    assert result.schema["n"].dataType == T.LongType() and set(rejected(result)) == {3}


def test_problems_below_structs_and_arrays(make_feed):
    result = conform(
        make_feed(
            (1, "insert", "1", '{"s":{"a":1},"l":[1,2],"m":[{"x":"t"}]}'),
            (2, "insert", "2", '{"s":{"a":"no"}}'),
            (3, "insert", "3", '{"l":[1,"no"]}'),
            (4, "insert", "4", '{"m":[{"x":"t"},{"x":{"$numberDecimal":"1"}}]}'),
            (5, "insert", "5", '{"s":4}'),
            (6, "insert", "6", '{"m":[{"x":"t"},{"x":null},{"y":1}]}'),
        )
    )
    assert set(rejected(result)) == {2, 3, 4, 5}
    assert rejected(result)[4] == "Decimal128" and "s.a" in rejected(result)[2]
    assert accepted(result)["6"]["m"] == [{"x": "t", "y": None}, {"x": None, "y": None}, {"x": None, "y": 1}]


def test_rejects_that_are_not_about_types(make_feed):
    result = conform(
        make_feed(
            (1, "insert", "1", '{"amount":1}'),
            (2, "insert", "2", '{"Amount":1}'),
            (3, "insert", "3", "not json"),
            (4, "insert", "4", '{"a":1,"a":2}'),
            (5, "insert", "5", '{"__seq":1}'),
            (6, "insert", None, '{"amount":1}'),
            (7, "insert", "7", None),
            (8, "insert", "8", "{}"),
        )
    )
    assert set(rejected(result)) == {2, 3, 4, 5, 6, 7}
    assert rejected(result)[2] == "case-insensitive name collision" and rejected(result)[5] == "reserved field name"
    assert set(accepted(result)) == {"1", "8"}


def test_missing_post_image_fails_or_is_set_aside(make_feed):
    feed = make_feed((1, "insert", "1", '{"a":1}'), (2, "update", "1", None))
    with pytest.raises(PySparkException, match="post-image"):
        conform(feed).accepted.collect()
    assert rejected(conform(feed, missing_post_image="dlq")) == {2: "post-image was not found"}


def test_fields_are_found_at_every_depth(make_feed):
    feed = make_feed(
        (1, "insert", "1", '{"a":{"b":[{"c":1.5},{"d":{"$date":"2026-01-01T00:00:00Z"}}]},"e":"x"}'),
        (2, "insert", "2", '{"a":{"b":[]},"f":true,"e":{"$numberDecimal":"1"},"g":{"h":{"i":{"j":{"k":{"l":1}}}}}}'),
    )
    documents = read_documents(feed).withColumn("_members", conform_module._members(F.col("_doc")))
    found, more = observed_fields(documents)
    assert set(found) == set(observed_fields(documents, levels_at_once=2)[0])
    assert not more and {(o.path, o.kind, o.wrapped): o.seq for o in found} == {
        (("a",), "object", False): 1, (("a", "b"), "array", False): 1, (("a", "b", None), "object", False): 1,
        (("a", "b", None, "c"), "double", False): 1, (("a", "b", None, "d"), "timestamp", True): 1, (("e",), "string", False): 1,
        (("f",), "boolean", False): 2, (("e",), "decimal128", True): 2, (("g",), "object", False): 2,
        (("g", "h"), "object", False): 2, (("g", "h", "i"), "object", False): 2, (("g", "h", "i", "j"), "object", False): 2,
        (("g", "h", "i", "j", "k"), "object", False): 2, (("g", "h", "i", "j", "k", "l"), "bigint", False): 2,
    }


def test_a_document_too_wide_is_set_aside_and_stops_nothing(make_feed):
    wide = "{" + ",".join(f'"data{i}":{i}' for i in range(20_000)) + "}"
    result = conform(make_feed((1, "insert", "1", '{"a":1}'), (2, "insert", "2", wide), (3, "insert", "3", '{"b":"x"}')))
    assert rejected(result) == {2: "more fields than a table holds"}
    assert result.schema.names == ["a", "b"] and set(accepted(result)) == {"1", "3"}


@pytest.mark.parametrize("names", [5, 40])
def test_a_full_table_takes_no_further_fields(make_feed, names):
    feed = make_feed(*[(i, "insert", str(i), '{"f%d":%d,"s":{"t":1}}' % (i, i)) for i in range(names)], (99, "insert", "99", '{"f0":9}'))
    result = conform(feed, width=4)
    assert result.schema.names == ["f0", "s", "f1"]
    assert rejected(result) == {i: "more fields than a table holds" for i in range(2, names)}
    assert set(accepted(result)) == {"0", "1", "99"}


def test_a_batch_that_fits_needs_no_check(make_feed):
    good = make_feed((1, "insert", "1", '{"a":1.25,"b":{"c":[1]}}'), (2, "delete", "1", None))
    assert conform(good).clean
    for bad in ("nope", '{"a":"x"}', '{"b":{"c":[1,"x"]}}', '{"A":1}'):
        assert not conform(good.unionByName(make_feed((3, "insert", "2", bad)))).clean


scalars = st.one_of(
    st.none(), st.booleans(), st.integers(-5, 5), st.sampled_from([0.5, 2.25]), st.sampled_from(["x", "y"]),
    st.just({"$numberDecimal": "1"}), st.just({"$date": "2026-01-01T00:00:00Z"}), st.just({"$oid": "ab"}),
)
values = st.recursive(
    scalars,
    lambda inner: st.one_of(st.lists(inner, max_size=2), st.dictionaries(st.sampled_from(["p", "P", "q.r", "s"]), inner, max_size=2)),
    max_leaves=4,
)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.dictionaries(st.sampled_from(["a", "b", "A", "c.d"]), values, max_size=3), min_size=1, max_size=6))
def test_judging_by_form_and_by_value_agree(make_feed, documents):
    events = [(n, "insert", str(n), json.dumps(d)) for n, d in enumerate(documents)]
    feed = make_feed(*events)
    fast = conform(feed)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(conform_module, "UNCLEAR_FORM", ".*")
        patch.setattr(conform_module, "UNCLEAR_SIGNS", ("OBJECT<",))
        slow = conform(feed)
    assert fast.schema == slow.schema
    assert rejected(fast) == rejected(slow) and accepted(fast) == accepted(slow)


def test_forms_that_hide_something_are_looked_at_by_value(make_feed):
    result = conform(
        make_feed(
            (1, "insert", "1", '{"l":[{"$oid":"a"}]}'),
            (2, "insert", "2", '{"l":[{"$oid":"a"},{}]}'),
            (3, "insert", "3", '{"l":[{"$numberDecimal":"1"},{"$oid":"ab"}]}'),
            (4, "insert", "4", '{"DECIMAL(2,0)":1.5,"l":[]}'),
        )
    )
    assert set(rejected(result)) == {2, 3} and accepted(result)["4"]["DECIMAL(2,0)"] == 1.5


def test_numbers_beside_a_wrapped_value_hide_nothing(make_feed):
    """A quoted name before a decimal is no name that looks like one: the documents are of one form, not of one each."""
    wrapped = [(i, "insert", str(i), f'{{"at":{{"$date":"2024-01-0{i % 9 + 1}T00:00:00Z"}},"p":{i}.25}}') for i in range(1, 40)]
    rows = lambda feed: forms_of(_with_form(read_documents(feed))).collect()
    (one,) = rows(make_feed(*wrapped))
    assert one._exact == "" and "`$date`" in one._form
    for name in ("DECIMAL(3,1)", "a`DECIMAL(3,1)", "$date`DECIMAL(3,1)`"):
        feed = make_feed(*[(i, "insert", str(i), f'{{"a b":1.5,"{name}":{i}.25,"z z":2.5}}') for i in (1, 2)])
        assert sorted(r._exact for r in rows(feed)) == sorted(r.full_document for r in feed.collect())


def test_one_document_of_each_form_is_parsed_again_where_all_share_a_seq(make_feed):
    """As in a sync: which document is an example is not told by its seq."""
    feed = make_feed(*[(0, "insert", str(i), f'{{"p":{i}}}' if i % 2 else f'{{"q":"{i}"}}') for i in range(200)])
    forms = forms_of(_with_form(read_documents(feed)))
    prints = [r._print for r in forms.collect()]
    assert len(prints) == 2 and feed.where(F.xxhash64("full_document").isin(prints)).count() == 2
    assert sorted(r._form for r in _examples(feed, forms).collect()) == ["OBJECT<p: BIGINT>", "OBJECT<q: STRING>"]


def test_large_document(make_feed):
    text = "x" * 200_000
    rows = accepted(conform(make_feed((1, "insert", "1", '{"t":"%s"}' % text))))
    assert rows["1"]["t"] == text


def test_encoded_rows_come_back_typed(spark, make_feed):
    source = spark.sql(
        "select '7' as `_id`, 1.5D as amount, timestamp'2026-01-01 10:00:00.25' as at, X'0102' as b, "
        "named_struct('n', 3L, 't', timestamp'2026-01-02 00:00:00') as s, cast(1.5 as decimal(9,2)) as money, "
        "cast(null as string) as nothing"
    )
    text = source.select(encode_document(source)).first()[0]
    assert '"money":{"$numberDecimal":"1.50"}' in text and "nothing" not in text
    back = conform(make_feed((1, "insert", "7", text)))
    assert rejected(back) == {1: "Decimal128"}
    without = source.drop("money")
    text = without.select(encode_document(without)).first()[0]
    row = accepted(conform(make_feed((1, "insert", "7", text))))["7"]
    assert row["at"].microsecond == 250000 and row["s"]["n"] == 3 and bytes(row["b"]) == b"\x01\x02"


def test_sanitise_typed_frame(spark):
    source = spark.sql("select 1 as `a.b`, 2 as a_b, named_struct('x.y', 1, 'x_y', 2) as n, array(named_struct('$q', 2)) as i, map('k.1', 1, 'k_1', 2, 'z', 3) as m")
    clean = names.sanitise(source)
    assert clean.columns == ["a_b", "n", "i", "m"]
    row = clean.first()
    assert row.a_b == 2 and row.n.asDict() == {"x_y": 2} and row.i[0].asDict() == {"_q": 2} and row.m == {"k_1": 2, "z": 3}


def test_mask_by_name(spark):
    source = spark.sql(
        "select 'a' as user_email, 'b' as plain, named_struct('ApiToken', 1, 'deep', named_struct('cpf', '1', 'x', 2)) as s, "
        "array(named_struct('secretKey', 's', 'y', 1)) as l, map('password', 'p', 'n', 'v') as m"
    )
    row = names.mask_by_name(source).first().asDict(recursive=True)
    assert row == {
        "user_email": "<mascarado>",
        "plain": "b",
        "s": {"ApiToken": "<mascarado>", "deep": {"cpf": "<mascarado>", "x": 2}},
        "l": [{"secretKey": "<mascarado>", "y": 1}],
        "m": {"password": "<mascarado>", "n": "v"},
    }


def test_known_forms_are_not_looked_at_again(spark, make_feed):
    """A batch of forms that fitted before is typed without exploring it; anything new or odd is looked at."""
    tracker, memory = spark.sparkContext.statusTracker(), conform_module.Memory()

    def jobs(feed, schema, name):
        spark.sparkContext.setJobGroup(name, "")
        found = conform(feed, schema, memory=memory)
        spark.sparkContext.setJobGroup("rest", "")
        return found, len(tracker.getJobIdsForGroup(name))

    one = '{"a":%d,"o":{"x":"y"}}'
    first, many = jobs(make_feed((1, "insert", "1", one % 1), (2, "insert", "2", '{"a":1}')), None, "first")
    again, few = jobs(make_feed((3, "insert", "1", one % 5), (4, "delete", "2", None)), first.schema, "again")
    assert few < many and few <= 3 and again.clean and again.schema == first.schema
    assert {(r["_id"], r.a, r["__alive"]) for r in again.accepted.collect()} == {("1", 5, True), ("2", None, False)}
    for n, (bad, fits) in enumerate([('{"a":"x"}', False), ("nope", False), ('{"a":1,"b":2}', True), ('{"A":1}', False), ('{"a":{"$numberDecimal":"1"}}', False)]):
        found, _ = jobs(make_feed((5, "insert", "3", bad), (6, "insert", "4", one % 6)), first.schema, f"new-{n}")
        assert set(rejected(found)) == (set() if fits else {5}) and len(accepted(found)) == (2 if fits else 1)
    assert conform(make_feed((7, "insert", "1", one % 7)), memory=memory).schema == first.schema
