"""Expressions that no table query reaches."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fieldframe import functions
from fieldframe.functions import checksum, context, fmt, routing, spatial, transport, vectors
from fieldframe.operators import bridge, delta, records, registry


def one(spark, col):
    return spark.range(1).select(col.alias("c")).first()[0]


@pytest.mark.parametrize("x", [0.0, 1.0, -2.5, 1e7, 1.5e10, 123456789012345680.0, 1e-7, 1.25e-5, -3e-12, 1e22, 0.1])
def test_float_text(spark, x):
    from fieldframe.sources.values import float_text

    got = one(spark, fmt.float_text(F.lit(x)))
    assert got == float_text(x)
    assert float(got) == x


def test_float_words(spark):
    assert [one(spark, fmt.float_text(F.lit(float(x)))) for x in ("nan", "inf", "-inf")] == ["NaN", "inf", "-inf"]
    assert one(spark, fmt.plain_float_text(F.lit(-0.0))) == "0"


def test_string_text(spark):
    from fieldframe.sources.values import string_text

    words = ["abc", "", "true", "1e5", "+1", ".5", "5.", "inf", "a b", 'q"x', "x\ny", "a\\b", "12", "é", "No", "x-1"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", fmt.string_text(F.col("w")).alias("t"))
    assert {r.w: r.t for r in df.collect()} == {w: string_text(w) for w in words}


def test_scores(spark):
    w = lambda fresh, imp, conf, risk: one(spark, context.composite(F.lit(fresh), F.lit(imp), F.lit(conf), F.lit(risk)))
    import math

    for age, imp, conf, risk, want in ((0, 128, 0.5, 0, 0.650784), (24, 128, 0.5, 0, 0.461148), (0, 255, 0.7, 0, 0.91), (0, 128, 0.5, 2, 0.325392), (48, 200, 0.7, 1, 0.451461)):
        assert round(w(math.exp(-age / 24), imp, conf, risk), 6) == want


def test_base_importance(spark):
    for priority, want in ((100, 0.521471), (150, 0.61951), (200, 0.717549), (255, 0.825392)):
        got = one(spark, routing.base_importance(F.lit(priority), F.lit(5), F.lit("x"), F.lit(5)))
        assert round(got, 6) == want


def test_empty_stats(spark):
    df = context.with_profile(spark.createDataFrame([], "timestamp_ms long, source string"), 0)
    assert tuple(context.stats(df).first()) == (0, 0.0, 0, 0.0, 0, 0, 0, 0)


def test_routing_table(spark):
    rows = [("Alert", 255, False, 0.1, "SendToLLM"), ("Alert", 200, False, 0.9, "ProcessLocally"), ("Alert", 255, True, 0.9, "Drop"), ("Event", 10, False, 0.7, "SendToLLM"), ("State", 10, False, 0.69, "ProcessLocally"), ("Command", 255, False, 1.0, "ProcessLocally"), ("Query", 255, False, 1.0, "ProcessLocally"), ("Event", 1, None, 0.8, None)]  # the last one has no time: an error, no decision
    df = spark.createDataFrame(rows, "kind string, p int, e boolean, i double, want string")
    got = df.select("want", routing.route(F.col("kind"), F.col("p"), F.col("e"), F.col("i")).alias("got")).collect()
    assert all(r.got == r.want for r in got)


def test_expiry(spark):
    assert one(spark, routing.is_expired(F.lit(None).cast("long"), F.lit(5), F.lit(9))) is None
    assert one(spark, routing.is_expired(F.lit(4), F.lit(5), F.lit(9))) is False
    assert one(spark, routing.is_expired_at(F.lit(9), F.lit(9))) is True
    assert one(spark, routing.parse_kind(F.lit("aLERT"))) == "Alert"


def test_vectors(spark):
    zero, a, b = (F.array(*[F.lit(x).cast("float") for x in v]) for v in ((0, 0), (3, 4), (1, 2)))
    assert one(spark, vectors.cosine(zero, a)) == 0.0
    assert one(spark, vectors.euclidean(a, b)) == pytest.approx(8**0.5)
    assert one(spark, vectors.dot(a, F.array(F.lit(1.0)))) is None
    assert one(spark, vectors.normalize(zero)) == [0.0, 0.0]
    assert one(spark, vectors.apply_delta(a, F.array(F.struct(F.lit(7).alias("index"), F.lit(1.0).cast("float").alias("delta"))))) is None
    assert one(spark, vectors.quantize_int8(F.array(F.lit(2.0).cast("float"))))["scale"] == 1.0
    assert one(spark, vectors.quantize_int8(F.array().cast("array<float>"))) is None
    odd = F.array(*[F.lit(float(x)).cast("float") for x in range(5)])
    assert one(spark, vectors.dequantize_int4(vectors.quantize_int4(odd))) == pytest.approx([0, 1, 2, 3, 4], abs=0.14)
    assert one(spark, vectors.dequantize_binary(vectors.quantize_binary(odd))) == [-1, -1, 1, 1, 1]


def test_spatial(spark):
    p = lambda x, y, z: spatial.position(F.lit(x), F.lit(y), F.lit(z))
    turn = F.struct(F.lit(0.0).alias("pitch"), F.lit(0.0).alias("yaw"), F.lit(0.0).alias("roll"))
    assert tuple(one(spark, spatial.transform(p(1, 0, 0), turn, p(1, 0, 0), p(1, 1, 1)))) == (2.0, 0.0, 0.0)
    assert tuple(one(spark, spatial.difference(p(10, 20, 30), p(11, 19, 32)))) == (1.0, -1.0, 2.0)
    assert tuple(one(spark, spatial.unit(p(0, 0, 0)))) == (0.0, 0.0, 0.0)
    box = lambda a, b: F.struct(p(a, a, a).alias("min"), p(b, b, b).alias("max"))
    assert one(spark, spatial.boxes_meet(box(0, 1), box(1, 2))) is True
    assert one(spark, spatial.boxes_meet(box(0, 1), box(1.5, 2))) is False


def test_checksum_text(spark):
    assert one(spark, checksum.show(checksum.field_checksum(F.lit(12), F.lit("i"), F.lit("14532")))) == "36AAE667"
    assert one(spark, checksum.read(F.lit("0x36AAE667"))) == 0x36AAE667
    assert one(spark, checksum.read(F.lit("36AAE66"))) is None


def test_records(spark):
    rec = records.record((5, "s", F.lit("")), (2, "i", F.lit(7)), (2, "i", F.lit(8)), (9, "fa", F.array(F.lit(1.5), F.lit(-0.0))))
    assert one(spark, records.text(rec, hints=True)) == "F2:i=7\nF2:i=8\nF9:fa=[1.5,-0]"
    assert one(spark, records.get(rec, 2)["i"]) == 7
    assert one(spark, F.size(records.remove(rec, 2))) == 2
    assert one(spark, F.size(records.add(rec, 1, "b", F.lit(True)))) == 5
    assert one(spark, records.order_violations(rec)) == 1
    assert one(spark, records.is_stable(rec)) is True
    assert one(spark, bridge.short_form(rec)) == '2=7;2=8;5="";9=[1.5,-0]'
    assert one(spark, records.limit_error(rec, max_fields=3)) == "TooManyFields"
    assert one(spark, records.limit_error(rec, max_items=1)) == "ArrayTooLong"


def test_depth(spark):
    rows = [(1, [], 0, 5, "r"), (1, [], 1, 6, "i"), (1, [], 2, 7, "r"), (1, [7], 0, 1, "r"), (1, [7, 1], 0, 2, "s")]
    df = spark.createDataFrame(rows, "id int, path array<int>, pos int, fid int, tag string")
    assert {r.top_fid: r.depth for r in records.depth(df, "id").collect()} == {5: 1, 6: 0, 7: 2}


def test_registry_file(spark, tmp_path):
    (tmp_path / "r.yaml").write_text("metadata:\n  version: 1.0\ncore:\n  - fid: 1\n    name: entity_id\n    type: Int\n    status: ACTIVE\n  - fid: 2\n    name: when\n    type: Int\n    unit: ms\nstandard:\n  - fid: 1100\n    name: other\n    type: String\n    status: DEPRECATED\n")
    rows = registry.read_yaml(spark, str(tmp_path / "r.yaml")).orderBy("fid").collect()
    assert [(r.fid, r.name, r.expected, r["range"], r.status, r.unit) for r in rows] == [(1, "entity_id", "Int", "Core", "ACTIVE", None), (2, "when", "Int", "Core", "ACTIVE", "ms"), (1100, "other", "String", "Standard", "DEPRECATED", None)]


def test_enforce(spark):
    reg = spark.createDataFrame([(1, "a", "Int", "Core", "TOMBSTONED")], "fid int, name string, expected string, range string, status string")
    with pytest.raises(Exception, match="Tombstoned"):
        registry.enforce(spark.createDataFrame([(1, "i")], "fid int, tag string"), reg).collect()


def test_delta_errors(spark):
    base = spark.createDataFrame([(1, 1, "a")], "r int, fid int, v string")
    ops = spark.createDataFrame([(1, 2, "Update", "b"), (1, 1, "Delete", None)], "r int, fid int, op string, v string")
    assert [tuple(r) for r in delta.apply(base, ops, ["r", "fid"], "v").collect()] == [(1, 2, "b", "InvalidTargetFid")]
    assert one(spark, delta.context_error(F.lit(0), F.lit(0), F.lit(5), F.lit(6))) == "WrongBaseSnapshot"


def test_strict_headers(spark):
    bad = F.create_map(F.lit("record.timestamp"), F.lit("x"))
    with pytest.raises(Exception, match="bad timestamp"):
        one(spark, transport.from_headers(bad, transport.KAFKA))
    lenient = F.create_map(F.lit("x-record-timestamp"), F.lit("x"), F.lit("traceparent"), F.lit("00-abc-def-01"))
    got = one(spark, transport.from_headers(lenient, transport.HTTP))
    assert (got.timestamp_ms, got.trace_id) == (None, "abc")
    assert tuple(one(spark, transport.message_of_headers(F.create_map().cast("map<string,string>"), transport.NATS))) == ("Event", 100, 5000, None)


def test_header_line(spark):
    env = transport.parse_header_line(F.lit(r'#ENVELOPE timestamp=5 source="a \"b\" c" mood=odd'))
    got = one(spark, env)
    assert (got.timestamp_ms, got.source, got.labels) == (5, 'a "b" c', {"mood": "odd"})
    assert one(spark, transport.parse_header_line(F.lit("F1=1"))) is None


def test_prompt(spark):
    assert one(spark, bridge.prompt_array(F.array(F.lit("a"), F.lit("b c"), F.lit("1x")))) == '[a,"b c","1x"]'
    assert one(spark, bridge.prompt_array(F.array(F.lit("a"), F.lit("b")), minimize=False)) == "[a, b]"


def test_sql_functions(spark):
    functions.register(spark)
    row = spark.sql("SELECT ff_checksum(12, 'i', '14532') a, ff_score(1e0, 128, 0.5e0, 0) b, ff_sanitize('F1=yes ; F2=a b') c, ff_canonical('F2=x;F1=y') d, ff_expand_short('1=x') e, ff_expired(1, 5, 9) f, ff_fid_range(300) g").first()
    assert (row.a, round(row.b, 6), row.c, row.d, row.e, row.f, row.g) == ("36AAE667", 0.650784, 'F1=yes;F2="a b"', "F1=y\nF2=x", "F1=x", True, "Standard")
