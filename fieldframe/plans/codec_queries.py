"""More queries: bytes of all kinds there and back, quantization by target, states, headers and errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import context, routing, spatial, transport, vectors
from ..operators import delta, negotiation, records, registry
from ..sources import binary, space, text, wire
from . import tables as t
from .queries import INT4, INT8, STEPS, _env, _r, _steps, query
from .tables import FIELDS, IMPORTANCE_SQL, MSG, NOW, POS, PRIORITY, REG_SQL, TTL

# ================================================================ vectors


LEVEL = "CASE vec_id % 5 WHEN 0 THEN 'fp16' WHEN 1 THEN 'qint8' WHEN 2 THEN 'qint4' WHEN 3 THEN 'binary' END"


def _leveled(spark, sf_dir, names):
    v = t.vec(spark, sf_dir)
    level = F.get(F.array(*[F.lit(n) for n in names]), (F.col("vec_id") % 5).cast("int"))
    some = F.when(F.col("vec_id") % 10 == 6, F.array().cast("array<float>")).otherwise(F.col("embedding"))
    return v.select("vec_id", some.alias("e"), vectors.scheme_of(level, names).alias("scheme")).withColumn("q", vectors.quantize(F.col("e"), F.col("scheme")))


@query(f"""WITH {INT8}, {INT4.replace('s AS', 's4 AS').replace('q AS', 'q4 AS').replace('FROM s)', 'FROM s4)')} SELECT q.vec_id, {LEVEL.replace('vec_id', 'q.vec_id')} AS scheme,
  CASE WHEN q.vec_id % 10 = 6 THEN 'InvalidDimension' WHEN q.vec_id % 5 = 4 THEN 'UnknownScheme' END AS error,
  CASE WHEN q.vec_id % 10 = 6 THEN NULL WHEN q.vec_id % 5 = 1 THEN list_sum(codes)::BIGINT WHEN q.vec_id % 5 = 2 THEN list_sum(list_transform(range(32), lambda i: c[2 * i + 1] * 16 + c[2 * i + 2]))::BIGINT END AS total FROM q JOIN q4 ON q.vec_id = q4.vec_id""")
def quant_adaptive(spark, sf_dir):
    """Schemes by wanted accuracy; every tenth vector is empty, every fifth asks for no known accuracy."""
    total = F.when(F.col("scheme").isin("qint8", "qint4"), F.aggregate("q.data", F.lit(0).cast("long"), lambda s, x: s + x))
    return _leveled(spark, sf_dir, vectors.ADAPTIVE).select("vec_id", "scheme", "q.error", total.alias("total"))


@query(f"""SELECT {LEVEL} AS scheme, count(*) AS total, count(*) FILTER (vec_id % 10 <> 6 AND vec_id % 5 <> 4) AS succeeded, count(*) FILTER (vec_id % 10 = 6 OR vec_id % 5 = 4) AS failed,
  (sum(CASE WHEN vec_id % 10 = 6 THEN 0 ELSE CASE vec_id % 5 WHEN 0 THEN 128 WHEN 1 THEN 64 WHEN 2 THEN 32 WHEN 3 THEN 8 ELSE 0 END END))::BIGINT AS bytes FROM embeddings GROUP BY 1""")
def quant_batch(spark, sf_dir):
    """Statistics of a batch by compression target, with vectors that fail."""
    return vectors.batch_stats(_leveled(spark, sf_dir, vectors.TARGET), "q")


@query("""WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS a, list_reverse(embedding)::DOUBLE[] AS b FROM embeddings)
  SELECT vec_id, 260 AS bytes, TRUE AS same, round(list_inner_product(a, b), 5) AS dot, round(list_cosine_similarity(a, b), 5) AS cosine, round(list_distance(a, b), 5) AS l2 FROM n""")
def vec_bytes(spark, sf_dir):
    """Vectors written, read, and compared with their reverse from the bytes."""
    v = t.vec(spark, sf_dir).withColumn("back", F.reverse("embedding"))
    data = binary.encode_vector(v, "embedding", "vec_id", "embedding", "back", out="a").drop("error")
    data = binary.encode_vector(data, "back", "vec_id", "embedding", "a", out="b").drop("error")
    read = binary.decode_vector(data, "a", "vec_id", "embedding", "a", "b", out="x").drop("error")
    read = binary.decode_vector(read, "b", "vec_id", "embedding", "a", "x", out="y")
    x, y = F.col("x"), F.col("y")
    return read.select("vec_id", F.octet_length("a").alias("bytes"), (x == F.col("embedding")).alias("same"), _r(vectors.dot(x, y), 5).alias("dot"), _r(vectors.cosine(x, y), 5).alias("cosine"), _r(vectors.euclidean(x, y), 5).alias("l2"))


# ================================================================ records in bytes

@query(f"SELECT o_orderkey AS rec_id, 6 AS n, o_orderkey + 10 AS key, o_custkey + 10 AS inner, o_custkey + 11 AS second, NULL::VARCHAR AS error FROM orders")
def nested_roundtrip(spark, sf_dir):
    """A record with a nested record and an array of two, as text, bytes and fields."""
    o = t.spread(t.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))
    c = F.col("o_custkey") + 10  # a bare 0 or 1 is a boolean
    line = F.format_string("F1=%d;F100={F12=%d};F101=[{F12=%d},{F12=%d}]", F.col("o_orderkey") + 10, c, c, c + 1)
    frames = binary.encode_text(o.select(F.col("o_orderkey").alias("rec_id"), line.alias("text")), "text", "rec_id", nested=True).drop("error")
    got = binary.decode_nested(frames, "frame", "rec_id")
    at = lambda path: F.get(F.filter("fields", lambda x: x["path"] == F.array(*[F.lit(p) for p in path]).cast("array<int>")), F.lit(0))["i"]
    return got.select("rec_id", F.size("fields").alias("n"), at([]).alias("key"), at([100]).alias("inner"), at([101, 2]).alias("second"), F.col("error.class").alias("error"))


@query(f"""WITH r AS (SELECT o_orderkey AS rec_id, 'F1=' || o_orderkey + 10 || chr(10) || 'F12=' || o_custkey + 10 AS canonical FROM orders)
  SELECT rec_id, CASE WHEN rec_id % 3 = 2 THEN NULL ELSE canonical END AS canonical, CASE WHEN rec_id % 3 = 2 THEN 'UnsupportedContentType' END AS error FROM r""")
def http_bodies(spark, sf_dir):
    """Records as bodies: frames, text, and a content type that nobody reads."""
    o = t.spread(t.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))
    rec = records.record((12, "i", F.col("o_custkey") + 10), (1, "i", F.col("o_orderkey") + 10))
    both = binary.encode_column(o.select(F.col("o_orderkey").alias("rec_id"), rec.alias("rec")), "rec", "rec_id", "rec").drop("error")
    key = F.col("rec_id")
    kind = F.when(key % 3 == 0, "application/octet-stream").when(key % 3 == 1, "text/plain").otherwise("image/png")
    sent = both.select("rec_id", F.when(key % 3 == 0, F.col("frame")).otherwise(records.text(F.col("rec")).cast("binary")).alias("body"), kind.alias("type"))
    got = wire.from_body(sent, "body", "type", "rec_id")
    shown = F.array_join(F.transform(F.array_sort(F.transform("fields", lambda x: F.struct(x["fid"].alias("fid"), x["i"].alias("i")))), lambda x: F.concat(F.lit("F"), x["fid"].cast("string"), F.lit("="), x["i"].cast("string"))), "\n")
    return got.select("rec_id", F.when(F.col("error").isNull(), shown).alias("canonical"), F.col("error.class").alias("error"))


@query(f"WITH {MSG} SELECT event_id, source, event_id AS sequence, k::BIGINT AS k, event_id::VARCHAR AS key FROM msg")
def kafka_records(spark, sf_dir):
    """Messages as rows for a Kafka sink, and read again as from a source."""
    m = _env(spark, sf_dir).select("event_id", "env", records.record((7, "i", F.regexp_extract(F.col("env.labels")["tenant"], "[0-9]+", 0).cast("long"))).alias("rec"))
    rows = wire.to_kafka(m, "rec", "env", F.col("event_id").cast("string"), "event_id")
    got = wire.from_kafka(rows.select("event_id", "key", "value", "headers"), "event_id", "key")
    return got.select("event_id", "envelope.source", "envelope.sequence", F.get("fields", F.lit(0))["i"].alias("k"), F.col("key").cast("string").alias("key"))


@query(f"""SELECT o_orderkey AS rec_id, CASE WHEN o_orderkey % 7 = 0 THEN 'Delete:24,' ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN 'Update:40,' ELSE '' END || CASE WHEN o_orderkey % 11 = 0 THEN 'Set:3,' ELSE '' END AS ops FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 11 = 0""")
def delta_bytes(spark, sf_dir):
    """Operations between two versions of a record as the bytes of a delta, and read again."""
    old, new = (records.to_fields(t.rec(spark, sf_dir, n), "rec", "rec_id").select("rec_id", "fid", F.to_json(F.struct("i", "f", "s", "sa")).alias("v")) for n in (False, True))
    ops = delta.diff(old, new, ["rec_id", "fid"], "v")
    held = ops.groupBy("rec_id").agg(F.collect_list(F.struct("fid", "op", F.coalesce("v", F.lit("")).cast("binary").alias("payload"))).alias("ops"))
    back = binary.decode_delta(binary.encode_delta(held, "ops", "rec_id").drop("error"), "delta", "rec_id")
    order = F.transform(F.array_sort(F.transform("ops", lambda x: F.struct(F.when(x["op"] == "Delete", 0).when(x["op"] == "Update", 1).otherwise(2).alias("k"), x["op"].alias("op"), x["fid"].alias("fid")))), lambda x: F.concat(x["op"], F.lit(":"), x["fid"].cast("string"), F.lit(",")))
    return back.select("rec_id", F.array_join(order, "").alias("ops"))


@query("""SELECT o_orderkey AS rec_id, 100 AS fid, 'Merge' AS op, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS n FROM orders UNION ALL SELECT o_orderkey, 1, 'Update', 1 FROM orders WHERE o_orderkey % 3 = 0""")
def delta_merge(spark, sf_dir):
    """Changes inside a nested record are one Merge of it."""
    o = t.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rec_id"), "o_custkey")
    key, none = F.col("rec_id"), F.array().cast("array<int>")
    inner = F.array(F.lit(100))
    row = lambda path, fid, v: F.struct(path.alias("path"), F.lit(fid).alias("fid"), v.cast("string").alias("v"))
    fields = lambda new: o.select("rec_id", F.inline(F.array(row(none, 1, F.when((key % 3 == 0) & F.lit(new), -1).otherwise(key)), row(none, 100, F.lit("{}")), row(inner, 12, F.col("o_custkey") + F.lit(int(new))), row(inner, 13, F.when((key % 2 == 0) & F.lit(new), 1).otherwise(0)))))
    ops = delta.diff(fields(False), fields(True), ["rec_id", "path", "fid"], "v")
    return delta.top_level(ops, "rec_id")


@query(f"""SELECT o_orderkey AS rec_id, CASE WHEN o_orderkey % 3 = 0 THEN 12 ELSE 77 END AS fid, CASE WHEN o_orderkey % 3 = 0 THEN 'MergeConflict' ELSE 'InvalidTargetFid' END AS error FROM orders WHERE o_orderkey % 3 < 2""")
def delta_errors(spark, sf_dir):
    base = t.fields(spark, sf_dir).select("rec_id", "fid", "tag")
    key = F.col("rec_id")
    ops = base.where("fid = 1").select("rec_id", F.when(key % 3 == 0, 12).when(key % 3 == 1, 77).otherwise(40).alias("fid"), F.when(key % 3 == 2, "Update").otherwise("Merge").alias("op"))
    return delta.merge_error(base, ops, "rec_id")


# ================================================================ states in space


@query(f"WITH {POS} SELECT l_orderkey, l_linenumber, round(x::FLOAT::DOUBLE, 6) AS x, round(y::FLOAT::DOUBLE, 6) AS y, round(z::FLOAT::DOUBLE, 6) AS z, 13 AS bytes, 'position' AS kind FROM pos")
def spa_bytes(spark, sf_dir):
    """Positions as bytes and back."""
    p = t.spread(t.pos(spark, sf_dir).select("l_orderkey", "l_linenumber", F.array("p.x", "p.y", "p.z").alias("v")))
    data = space.encode_column(p, "position", "v", "l_orderkey", "l_linenumber").drop("error")
    got = space.decode_column(data, "data", "l_orderkey", "l_linenumber", "data")
    point = lambda k: _r(F.get(F.get("value.points", F.lit(0)), F.lit(k)).cast("double"))
    return got.select("l_orderkey", "l_linenumber", *[point(k).alias(n) for k, n in enumerate(spatial.AXES)], F.octet_length("data").alias("bytes"), "value.kind")


@query(f"""WITH {STEPS} SELECT l_orderkey, seq, round(x - px, 6) AS dx, CASE WHEN seq % 2 = 0 THEN NULL ELSE round(y, 6) END AS vx, round(x, 6) AS x, CASE WHEN seq % 2 = 0 THEN round(py, 6) ELSE round(y, 6) END AS back FROM p WHERE px IS NOT NULL""")
def spa_state_delta(spark, sf_dir):
    """States' differences and the states after them: a missing velocity stays what it was."""
    s = _steps(spark, sf_dir).where("q is not null")
    kind = "struct<pitch:double,yaw:double,roll:double>"
    speed = lambda p: F.struct(p["y"].alias("x"), p["y"].alias("y"), p["y"].alias("z"))
    three = "struct<x:double,y:double,z:double>"
    state = lambda p, v: F.struct(p.alias("position"), F.lit(None).cast(kind).alias("rotation"), v.alias("velocity"), F.lit(None).cast(three).alias("acceleration"))
    old, new = state(F.col("q"), speed(F.col("q"))), state(F.col("p"), F.when(F.col("seq") % 2 == 1, speed(F.col("p"))))
    s = s.select("l_orderkey", "seq", old.alias("old"), new.alias("new")).withColumn("d", spatial.state_delta(F.col("old"), F.col("new")))
    s = s.withColumn("after", spatial.state_moved(F.col("old"), F.col("d")))
    return s.select("l_orderkey", "seq", _r("d.position.x").alias("dx"), _r("d.velocity.x").alias("vx"), _r("after.position.x").alias("x"), _r("after.velocity.x").alias("back"))


# ================================================================ messages and headers


@query(f"WITH {MSG} SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'MissingTimestamp' END AS error, CASE WHEN event_id % 10 = 0 THEN NULL WHEN greatest(now_ms - timestamp_ms, 0) > {TTL} THEN 'Drop' WHEN kind = 'Alert' AND priority > 200 THEN 'SendToLLM' ELSE 'ProcessLocally' END AS decision FROM msg")
def net_missing_time(spark, sf_dir):
    """Every tenth message has no time: an error, not a message that lives for ever."""
    m = t.msg(spark, sf_dir).withColumn("ts", F.when(F.col("event_id") % 10 != 0, F.col("timestamp_ms")))
    expired = routing.is_expired(F.col("ts"), routing.default_ttl_ms(F.col("kind")), F.col("now_ms"))
    return m.select("event_id", routing.expiry_error(F.col("ts")).alias("error"), routing.route(F.col("kind"), F.col("priority"), expired, F.lit(0.0)).alias("decision"))


@query(f"WITH {MSG} SELECT event_id, CASE WHEN event_id % 2 = 0 THEN priority ELSE {PRIORITY} END AS priority, CASE WHEN event_id % 3 = 0 THEN 77 ELSE {TTL} END::BIGINT AS ttl_ms FROM msg")
def net_qos(spark, sf_dir):
    """Headers without priority or time to live stand for the kind's own."""
    m = t.msg(spark, sf_dir)
    given = lambda n, v: F.when(F.col("event_id") % n == 0, v)
    h = transport.message_headers(F.col("kind"), given(2, F.col("priority")), given(3, F.lit(77)), F.lit(None).cast("string"), transport.HTTP)
    got = m.select("event_id", transport.message_of_headers(h, transport.HTTP).alias("m"), routing.quality_of_service(F.col("kind"), given(2, F.col("priority")), given(3, F.lit(77))).alias("q"))
    return got.select("event_id", F.when(F.col("m.priority") == F.col("q.priority"), F.col("m.priority")).alias("priority"), F.when(F.col("m.ttl_ms") == F.col("q.ttl_ms"), F.col("m.ttl_ms")).alias("ttl_ms"))


def _scheme_trip(spark, sf_dir, scheme):
    own = transport.message_headers(F.col("kind"), F.col("priority"), F.lit(None).cast("long"), F.lit("c"), scheme)
    h = _env(spark, sf_dir).select("event_id", F.map_concat(transport.to_headers(F.col("env"), scheme), own).alias("h"))
    got = h.select("event_id", transport.from_headers(F.col("h"), scheme).alias("e"), transport.message_of_headers(F.col("h"), scheme).alias("m"))
    return got.select("event_id", "e.timestamp_ms", "e.source", "e.trace_id", "e.sequence", F.col("e.labels")["Zone"].alias("zone"), "m.kind", "m.priority", "m.ttl_ms", "m.class")


TRIP = f"WITH {MSG} SELECT event_id, timestamp_ms, source, 'abc-' || to_hex(event_id) AS trace_id, event_id AS sequence, 'eu' AS zone, kind, priority, {TTL}::BIGINT AS ttl_ms, 'c' AS class FROM msg"


@query(TRIP)
def grpc_headers(spark, sf_dir):
    return _scheme_trip(spark, sf_dir, transport.GRPC)


@query(TRIP)
def nats_headers(spark, sf_dir):
    return _scheme_trip(spark, sf_dir, transport.NATS)


@query(f"WITH {MSG} SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'MalformedHeader' WHEN 2 THEN 'MalformedHeader' END AS error, source, CASE event_id % 4 WHEN 3 THEN 'later' ELSE 'one' END AS a FROM msg")
def env_header_errors(spark, sf_dir):
    """Header lines with a loose word, a time that is no number, and a label given twice."""
    key = F.col("event_id")
    line = F.concat(F.lit("#ENVELOPE timestamp="), F.when(key % 4 == 2, "soon").otherwise(F.col("timestamp_ms").cast("string")), F.lit(" source="), F.col("source"), F.when(key % 4 == 1, " loose").otherwise(""), F.lit(" a=one"), F.when(key % 4 == 3, " a=later").otherwise(""))
    m = t.msg(spark, sf_dir).select("event_id", line.alias("line"))
    back = transport.parse_header_line(F.col("line"))
    return m.select("event_id", transport.header_line_error(F.col("line")).alias("error"), back["source"].alias("source"), back["labels"]["a"].alias("a"))


@query(f"WITH {MSG}, s AS (SELECT *, CASE event_id % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'a spam mail' ELSE 'x' END AS status FROM msg) SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'SendToLLM' WHEN 1 THEN 'Drop' ELSE CASE WHEN kind = 'Alert' AND priority > 200 THEN 'SendToLLM' WHEN priority::DOUBLE / 255e0 >= 0.7e0 THEN 'SendToLLM' ELSE 'ProcessLocally' END END AS decision FROM s")
def net_presets(spark, sf_dir):
    key = F.col("event_id")
    m = t.msg(spark, sf_dir).withColumn("status", F.when(key % 3 == 0, "critical").when(key % 3 == 1, "a spam mail").otherwise("x"))
    rules = [routing.critical_to_llm("status"), routing.drop_spam("status")]
    return m.select("event_id", routing.route_by_content(m, rules, F.col("kind"), F.col("priority"), F.lit(False)).alias("decision"))


# ================================================================ context, registry, negotiation


@query(f"""WITH {IMPORTANCE_SQL}, f AS (SELECT d.doc_id, 22 AS fid FROM documents d UNION ALL SELECT doc_id, 41 FROM labels UNION ALL SELECT doc_id, 51 FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 99 FROM documents),
  r AS (SELECT doc_id, coalesce(max(importance), 128)::INTEGER AS importance, count(*)::VARCHAR AS n FROM f LEFT JOIN imp USING (fid) GROUP BY doc_id),
  e AS (SELECT r.*, d.lang, exp(-(greatest({NOW} - ({NOW} - doc_id % 240 * 900000), 0)::DOUBLE / 3600000e0) / 24e0) AS fresh FROM r JOIN documents d USING (doc_id))
  SELECT doc_id, importance, n AS field_count, lang, round(0.3e0 * 0.5e0 + 0.4e0 * importance / 255e0 + 0.3e0 * 0.5e0, 6) AS alone, round(0.3e0 * fresh + 0.4e0 * importance / 255e0 + 0.3e0 * 0.5e0, 6) AS combined FROM e""")
def ctx_record(spark, sf_dir):
    """Records' own profiles, and combined with their envelopes'."""
    d, labels = t.table(spark, sf_dir, "documents").select("doc_id", "lang"), t.table(spark, sf_dir, "labels")
    row = lambda df, fid: df.select("doc_id", F.lit(fid).alias("fid"))
    fields = row(d, 22).unionAll(row(labels, 41)).unionAll(row(labels.where("toxic = 1"), 51)).unionAll(row(d, 99))
    own = context.score_record(fields, spark.createDataFrame(t.IMPORTANCE, "fid int, importance int"), "doc_id")
    env = d.select("doc_id", (F.lit(NOW) - F.col("doc_id") % 240 * 900000).alias("timestamp_ms"), F.lit("x").alias("source"), F.create_map(F.lit("lang"), F.col("lang"), F.lit("field_count"), F.lit("?")).alias("hints"))
    both = context.score_combined(env, own, NOW, "doc_id")
    return both.join(own.select("doc_id", _r("score").alias("alone")), "doc_id").select("doc_id", "importance", F.col("hints")["field_count"].alias("field_count"), F.col("hints")["lang"].alias("lang"), "alone", _r("score").alias("combined"))


@query(f"WITH {REG_SQL}, w AS (SELECT DISTINCT (o_custkey % 60)::INTEGER AS fid FROM orders) SELECT reg.fid, reg.name FROM reg JOIN w USING (fid)")
def rsy_entries(spark, sf_dir):
    wanted = t.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 60).cast("int").alias("fid"))
    return registry.entries(t.registry(spark), wanted).select("fid", "name")


@query("SELECT o_orderkey AS peer, 1 > o_custkey % 3 OR (o_custkey % 3 = 1 AND 2 > o_orderkey % 5) AS ahead, o_custkey % 3 > 1 OR (o_custkey % 3 = 1 AND o_orderkey % 5 > 2) AS behind FROM orders")
def rsy_versions(spark, sf_dir):
    """Versions with a part that is no number: it is passed over."""
    o = t.table(spark, sf_dir, "orders")
    v = F.concat_ws(".", (F.col("o_custkey") % 3).cast("string"), F.lit("x"), (F.col("o_orderkey") % 5).cast("string"))
    return registry.peers(o.select(F.col("o_orderkey").alias("peer"), v.alias("version")), "1.2.0").select("peer", "ahead", "behind")


@query("""WITH w AS (SELECT o_orderkey, (['Integer', 'DOUBLE', 'boolean', 'Str', 'string_array', 'NestedRecord', 'thing', 'Any'])[o_orderkey % 8 + 1] AS word, (['active', 'Tombstoned', 'gone'])[o_orderkey % 3 + 1] AS s FROM orders)
  SELECT o_orderkey, (['Int', 'Float', 'Bool', 'String', 'StringArray', 'Record', NULL, 'Any'])[o_orderkey % 8 + 1] AS expected, (['ACTIVE', 'TOMBSTONED', NULL])[o_orderkey % 3 + 1] AS status FROM w""")
def reg_spellings(spark, sf_dir):
    key = F.col("o_orderkey")
    pick = lambda words: F.get(F.array(*map(F.lit, words)), (key % len(words)).cast("int"))
    word, s = pick(["Integer", "DOUBLE", "boolean", "Str", "string_array", "NestedRecord", "thing", "Any"]), pick(["active", "Tombstoned", "gone"])
    return t.table(spark, sf_dir, "orders").select("o_orderkey", registry.parse_type(word).alias("expected"), registry.parse_status(s).alias("status"))


@query(f"WITH {FIELDS} SELECT rec_id, fid, (3 + rec_id % 3)::INTEGER AS version, rec_id % 3 > 0 AND (tag <> 'i' OR rec_id % 2 = 0 OR rec_id % 3 = 2) AS reads FROM fields")
def neg_types(spark, sf_dir):
    """Whether peers of versions 3, 4 and 5 read a field; an odd record's numbers stand for nested records."""
    f = t.fields(spark, sf_dir).select("rec_id", "fid", F.when((F.col("tag") == "i") & (F.col("rec_id") % 2 == 1), "r").otherwise(F.col("tag")).alias("tag"), (F.col("rec_id") % 3 + 3).cast("int").alias("version"))
    return f.select("rec_id", "fid", "version", negotiation.supports_type(F.col("version"), F.col("tag")).alias("reads"))
