"""Codecs, pointers, identities and comparison."""

import hashlib
import json
import math
import random

import pytest

from tidewright.errors import WorkflowError
from tidewright.functions import codec, identity, pointer
from tidewright.operators.compare import first_difference, first_table_difference


@pytest.mark.parametrize("x,text", [
    (0, "0"), (1.0, "1"), (-1.5, "-1.5"), (1e21, "1e+21"), (1e20, "100000000000000000000"), (1.5e300, "1.5e+300"), (1e-6, "0.000001"), (1e-7, "1e-7"), (1.25e-7, "1.25e-7"),
    (0.1, "0.1"), (123456789.125, "123456789.125"), (5e-324, "5e-324"), (2**53 - 1, "9007199254740991"), (1.7976931348623157e308, "1.7976931348623157e+308"), (0.00001, "0.00001"), (100.5, "100.5"),
])
def test_numbers_print_shortest(x, text):
    assert codec.number_text(x) == text and float(text) == x


def test_numbers_read_back():
    rng = random.Random(1)
    for _ in range(5000):
        x = rng.uniform(-1, 1) * 10 ** rng.randint(-30, 30)
        assert float(codec.number_text(x)) == x


@pytest.mark.parametrize("bad", [float("nan"), math.inf, -math.inf, -0.0, 2**53, {1}, b"x", (1,), {1: 2}, object(), [object()]])
def test_values_without_json_form(bad):
    with pytest.raises(WorkflowError) as e:
        codec.encode_ordered(bad)
    assert e.value.code == "invalid_value"


def test_key_order():
    assert codec.encode_ordered({"b": 1, "10": 2, "2": 3, "a": None}) == '{"2":3,"10":2,"b":1,"a":null}'
    assert codec.encode_sorted({"b": 1, "10": 2, "2": 3}) == '{"10":2,"2":3,"b":1}'
    assert codec.encode_sorted({"": 1, "\U0001f600": 2}) == '{"\U0001f600":2,"":1}'  # UTF-16 order


@pytest.mark.parametrize("text", ['{"a":1,"a":2}', '{"a": 1}', "﻿1", "1.0", "01", "[1,]", "NaN", '"\\u0041"', "-0", '{"b":1,"2":1}'])
def test_decoding_is_strict(text):
    with pytest.raises(WorkflowError):
        codec.decode(text.encode())
    with pytest.raises(WorkflowError):
        codec.decode(b"\xff")


def test_decoding_inverts_encoding():
    for v in (None, True, [1, 2.5, "é\ud800"], {"z": [2, 1], "a": None, "1": {}}, 1e21, 1e300):
        assert codec.encode_ordered(codec.decode(codec.encode_ordered(v))) == codec.encode_ordered(v)


def test_pointers():
    v = {"a/b~": [10, {"": None}], "01": 1}
    assert pointer.resolve(v, "/a~1b~0/0") == 10 and pointer.resolve(v, "/a~1b~0/1/") is None and pointer.resolve(v, "") is v
    assert all(pointer.resolve(v, p) is pointer.MISSING for p in ("/x", "/a~1b~0/00", "/a~1b~0/2", "/a~1b~0/-1", "/01/0"))
    assert pointer.resolve(v, "/01") == 1 and pointer.escape("a/b~") == "a~1b~0"
    assert pointer.select_inputs({"a": None}, ["/a", "/b"]) == {"/a": {"contract": "required-json-v1", "state": "present", "value": None}, "/b": {"contract": "required-json-v1", "state": "missing"}}


# left, right, path, reason
VECTORS = [
    (None, None, None, None), (1, 2, "", "value"), (1, "1", "", "type"), (True, 1, "", "type"), ({"a": 0, "b": 1}, {"b": 2, "a": 0}, "", "object_order"), ({"a": 0}, {"b": 0}, "", "object_keys"),
    ({"a/b~": [1]}, {"a/b~": [2]}, "/a~1b~0/0", "value"), ([0], [1, 2], "", "array_length"),
]


@pytest.mark.parametrize("left,right,path,reason", VECTORS)
def test_first_difference(left, right, path, reason):
    assert first_difference(left, right) == (None if reason is None else {"path": path, "reason": reason})


def test_digest_column_equals_python(spark):
    row = spark.createDataFrame([("é",)], "t string").select(identity.digest_column("d/v1", __import__("pyspark").sql.functions.encode("t", "UTF-8")).alias("d")).first()
    assert row.d == identity.digest("d/v1", "é".encode()) == "sha256:" + hashlib.sha256(b"d/v1\0" + "é".encode()).hexdigest()


def test_bag_digest(spark):
    rows = [(1, "a", 0.0, None), (1, "a", 0.0, None), (2, None, float("nan"), [1]), (3, "", 1.5, [])]
    ddl = "i int, s string, d double, l array<int>"
    base = identity.bag_digest(spark.createDataFrame(rows, ddl)).first()
    again = identity.bag_digest(spark.createDataFrame(rows[::-1], ddl).repartition(3)).first()
    assert base == again and base["rows"] == 4
    for other in (rows[:3], rows[1:], [*rows[:3], (3, None, 1.5, [])], [(1, "a", -0.0, None), *rows[1:3], (3, "", 1.5, None)]):
        assert identity.bag_digest(spark.createDataFrame(other, ddl)).first().digest != base.digest
    assert identity.bag_digest(spark.createDataFrame([], ddl)).first()["rows"] == 0


def test_ordered_digest_needs_a_total_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert identity.ordered_digest(df, ["k"]).first().digest != identity.bag_digest(df).first().digest
    with pytest.raises(WorkflowError) as e:
        identity.ordered_digest(df.union(df), ["k"])
    assert e.value.code == "order_not_total"


def test_table_differences(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", None)], "k int, v string, w double")
    b = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0)], "k int, v string, w double")
    assert first_table_difference(a, a) is None and first_table_difference(a, a, ["k"]) is None
    assert first_table_difference(a, b, ["k"]) == {"path": '/{"k":2}/w', "reason": "value"}
    assert first_table_difference(a, b.where("k = 1"), ["k"]) == {"path": '/{"k":2}', "reason": "row"}
    assert first_table_difference(a, b)["reason"] == "row" and first_table_difference(a, b.drop("w"))["reason"] == "schema"
    assert first_table_difference(a.union(a), a)["reason"] == "row"


def test_json_matches_python_on_plain_values():
    v = {"a": [1, True, None, "x\n"], "b": {"c": 1.25}}
    assert codec.encode_ordered(v) == json.dumps(v, separators=(",", ":"))


def test_pointer_columns_match_the_walk(spark):
    from pyspark.sql import functions as F

    docs = [{"a/b": {"~x": [1, None, {"k": "v"}]}, "0": "zero", "list": [[7], "s"], "n": None, "t": True, 'q"z': 1.5}, [1, [2]], "text", None, 3, {}]
    pointers = ["", "/a~1b/~0x/0", "/a~1b/~0x/1", "/a~1b/~0x/2/k", "/a~1b/~0x/3", "/0", "/list/0/0", "/list/01", "/list/-1", "/n", "/t", '/q"z', "/1/0", "/missing"]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(len(docs), "{"), (len(docs) + 1, None)], "i int, d string")
    columns = [c for k, p in enumerate(pointers) for c in (pointer.pointer_state(F.col("d"), p).alias(f"s{k}"), pointer.pointer_text(F.col("d"), p).alias(f"t{k}"))]
    for r in df.select("i", *columns).collect():
        for k, p in enumerate(pointers):
            want = pointer.resolve(docs[r.i], p) if r.i < len(docs) else pointer.MISSING
            assert r[f"s{k}"] == ("missing" if want is pointer.MISSING else "present"), (r.i, p)
            if want is pointer.MISSING or want is None:
                assert r[f"t{k}"] is None
            elif isinstance(want, str):
                assert r[f"t{k}"] == want
            else:
                assert json.loads(r[f"t{k}"]) == want
    assert pointer.project_inputs({"a": None, "b": [1]}, ["/a", "/b/0", "/c"]) == {"/a": None, "/b/0": 1}


def test_digests_fold_nested_values(spark):
    one = lambda sql: identity.bag_digest(spark.sql(f"select {sql} as v")).first().digest
    assert one("map('a', 1, 'b', 2)") == one("map('b', 2, 'a', 1)") != one("map('b', 1, 'a', 2)")
    assert one("array(named_struct('x', -0.0D))") == one("array(named_struct('x', 0.0D))") != one("array(named_struct('x', cast(null as double)))")
    assert one("named_struct('m', map('k', array(cast('NaN' as double))))") == one("named_struct('m', map('k', array(double('NaN'))))")
    assert one("cast(null as struct<x: int>)") != one("named_struct('x', cast(null as int))")
    assert one("array(X'00')") != one("array(X'01')")


def test_bag_digest_is_order_free_and_counts(spark):
    rows = spark.range(5000).selectExpr("id", "cast(id as string) as s", "if(id % 3 = 0, null, id / 7) as d")
    a = identity.bag_digest(rows.repartition(7)).first()
    assert a == identity.bag_digest(rows.orderBy("s").coalesce(1)).first() and a.rows == 5000
    assert identity.bag_digest(rows.union(rows)).first().digest != a.digest
    empty = identity.bag_digest(rows.where("id < 0")).first()
    assert empty.rows == 0 and empty.digest != a.digest


def test_time_texts(spark):
    from pyspark.sql import functions as F

    from tidewright.operators.integrity import is_time, time_column

    texts = ["2024-02-29T00:00:00.000Z", "2023-02-29T00:00:00.000Z", "2024-01-01T23:59:59.999Z", "2024-01-01T24:00:00.000Z", "2024-1-01T00:00:00.000Z", "2024-01-01T00:00:00Z", "", None, "2024-01-01T00:00:00.000Z\n"]
    got = [r.t for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").orderBy("i").select(time_column(F.col("x")).alias("t")).collect()]
    assert got == [is_time(t) for t in texts] == [True, False, True, False, False, False, False, False, False]


def test_reachable_counts_ways_once(spark):
    """A ladder of diamonds has a row a node however many ways lead there; a cycle is an error."""
    from tidewright.operators.diff import reachable

    edges = [(f"n{k}", f"{side}{k}") for k in range(6) for side in "ab"] + [(f"{side}{k}", f"n{k + 1}") for k in range(6) for side in "ab"] + [("n0", "n6"), ("z", "y")]
    got = {r.node: r.depth for r in reachable(spark, spark.createDataFrame(edges, "src string, dst string"), "n0").collect()}
    assert got == {f"n{k}": 2 * k for k in range(7)} | {f"{s}{k}": 2 * k + 1 for k in range(6) for s in "ab"}
    with pytest.raises(WorkflowError) as e:
        reachable(spark, spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string"), "a")
    assert e.value.code == "cycle"
