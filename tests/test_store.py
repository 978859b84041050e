"""Enrichment, timeline, export, segments, streaming."""

import json
import random

from pyspark.sql import functions as F

from tidewire.functions import netaddr
from tidewire.operators import enrich as E
from tidewire.operators import export as X
from tidewire.operators.correlate import Anchor, timeline
from tidewire.sources import storage

T0 = 1_788_998_400 * 1_000_000
S = 1_000_000


def flows(spark, n=50):
    rows = []
    for i in range(n):
        dst = "203.0.113.9" if i % 5 == 0 else f"198.51.100.{i % 256}"
        rows.append((i, 0, T0 + 10 * i * S, T0 + 10 * i * S + S, "192.168.99.31" if i % 2 == 0 else "192.168.99.40", dst, netaddr.v4_range("192.168.99.31" if i % 2 == 0 else "192.168.99.40")[0], netaddr.v4_range(dst)[0], 4000, 443, 6, 5, 1000, 1, 7 if i % 2 == 0 else 8, None, "DE", 3320, "https", 1, 1, 1, 1, "e", 1))
    ddl = "flow_id bigint, origin smallint, start_time bigint, end_time bigint, src_ip string, dst_ip string, src_v4 bigint, dst_v4 bigint, src_port int, dst_port int, protocol int, packets bigint, octets bigint, direction int, src_client_id bigint, dst_client_id bigint, dst_country string, dst_asn bigint, service string, sampling_interval bigint, src_vlan int, dst_vlan int, tcp_flags int, exporter_addr string, flow_count bigint"
    return spark.createDataFrame(rows, ddl)


def test_addresses(spark):
    rows = [("10.1.2.3",), ("256.1.1.1",), ("100.64.0.1",), ("127.0.0.1",), ("8.8.8.8",), ("x",), (None,)]
    df = spark.createDataFrame(rows, "ip string").select("ip", netaddr.v4_kind(netaddr.v4_to_long(F.col("ip"))).alias("k"))
    assert [r.k for r in df.collect()] == ["private", None, "private", "loopback", "global", None, None]
    v6 = spark.createDataFrame([("2001:db8::5",), ("2001:db9::1",), ("1.2.3.4",)], "ip string").select(netaddr.in_prefix(F.col("ip"), "2001:db8::/32").alias("h"))
    assert [r.h for r in v6.collect()] == [True, False, False]
    mac = spark.createDataFrame([("AA-BB-CC-00-11-22",), ("nope",)], "m string").select(netaddr.canonical_mac(F.col("m")).alias("m"))
    assert [r.m for r in mac.collect()] == ["aa:bb:cc:00:11:22", None]


def test_longest_prefix_and_flattening(spark):
    prefixes = [("203.0.113.0/24", "DE", 3320, "a"), ("203.0.113.128/25", "US", 1, "b")]
    got = E.longest_prefix(spark.createDataFrame([(netaddr.v4_range(ip)[0],) for ip in ("203.0.113.5", "203.0.113.200", "8.8.8.8")], "a bigint"), "a", E.prefix_table(spark, prefixes))
    assert sorted((r.a, r.country) for r in got.collect()) == sorted([(netaddr.v4_range("203.0.113.5")[0], "DE"), (netaddr.v4_range("203.0.113.200")[0], "US"), (netaddr.v4_range("8.8.8.8")[0], None)])
    assert [r[2] for r in E.flatten_prefixes(prefixes)] == ["DE", "US"]


def test_identity_moves_on_the_third_sighting(spark):
    seen = [("10.0.0.5", m, None, i, s) for i, (m, s) in enumerate([("a", "arp"), ("b", "arp"), ("a", "arp"), ("b", "arp"), ("b", "arp"), ("b", "arp"), ("c", "dhcp")])]
    got = E.resolve_identities(spark.createDataFrame(seen, "ip string, mac string, hostname string, at bigint, source string")).orderBy("valid_from").collect()
    assert [(r.mac, r.valid_from, r.valid_to) for r in got] == [("a", 0, 5), ("b", 5, 6), ("c", 6, None)]


def test_timeline(spark):
    ev = spark.createDataFrame([(i, 0, T0 + (50 * i + 5) * S, None, "203.0.113.9", "192.168.99.31", 1, 2, "WAN_LOCAL-D-1", None, 9, 7) for i in range(10)], "event_id bigint, origin smallint, received_at bigint, event_time bigint, src_ip string, dst_ip string, event_type int, action int, rule_name string, ids_signature string, src_client_id bigint, dst_client_id bigint")
    notes = spark.createDataFrame([(1, T0 + 100 * S, "note")], "note_id int, at bigint, text string")
    gap = spark.createDataFrame([(1, T0 + 200 * S, T0 + 260 * S, "sleep")], "gap_id int, start_ts bigint, end_ts bigint, reason string")
    entries, more = timeline(Anchor(T0, T0 + 3600 * S, at=T0, client_id=7), flows(spark), ev, notes=notes, gaps=gap)
    rows = entries.collect()
    kinds = [r.kind for r in rows]
    assert (kinds.count("flow"), kinds.count("firewall"), kinds.count("annotation"), kinds.count("gap")) == (25, 10, 1, 1)
    assert [r.time for r in rows] == sorted(r.time for r in rows) and not more.first().truncated
    assert "same client" in rows[0].relations
    by_address = timeline(Anchor(T0, T0 + 3600 * S, addresses=("203.0.113.9",)), flows(spark), ev)[0].collect()
    assert [r.kind for r in by_address].count("flow") == 10


def test_redaction(spark):
    policy = X.sharing("s")
    r = X.flatten_flows(flows(spark), policy).orderBy("id").first()
    assert r.source.startswith("ip-") and len(r.source) == 15 and r.destination == "203.0.113.9" and r.sampled is False
    text = spark.createDataFrame([("from 10.0.0.1 to 2001:db8::1 at 12:30",)], "t string").select(X.redact_text(F.col("t"), policy).alias("t")).first().t
    assert "10.0.0.1" not in text and "2001:db8::1" not in text and "12:30" in text
    line = X.csv_line(spark.createDataFrame([('a,"b"', 1, None)], "x string, y int, z string")).first().line
    assert line == '"a,""b""",1,'
    body = json.loads(X.json_envelope(flows(spark, 3).select("flow_id", "src_ip"), "flows", "now", policy))
    assert body["count"] == 3 and body["records"][0]["flow_id"] == 0 and "internal addresses" in body["redaction"]


def test_redact_text_query_covers_all_texts(spark, tmp_path):
    import ipaddress
    import re

    from tidewire.plans import registry

    def addresses(text):
        n = 0
        for run in re.findall(r"[0-9A-Fa-f.:]+", text or ""):
            run = run.strip(".") if ":" not in run else run.rstrip(".")  # what ends a sentence is no part of an address
            try:
                n += ipaddress.ip_address(run).version > 0 if "." in run or run.count(":") >= 2 else 0
            except ValueError:
                pass
        return n

    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    odd = ["Version 2.0. Host 10.1.2.3 is up", "see 10.0.0.1. Then 192.168.7.9 (9.x)", "10.2.3.4 in 1999.", "no address in 3.", "from 2001:db8::1 at 5. of May", "", None, "it is 10.0.0.1.", "...10.0.0.2..."]
    rows += [(10**9 + i, t) for i, t in enumerate(odd)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {i: addresses(t) for i, t in rows if addresses(t)}
    assert [want.get(10**9 + i, 0) for i in range(9)] == [1, 2, 1, 0, 1, 0, 0, 1, 1]
    assert {r.doc_id: r.hidden for r in registry.QUERIES["redact_text"](spark, str(tmp_path)).collect()} == want


def test_segments(spark, tmp_path):
    from tidewire.operators.rollups import aggregate_flows

    df = flows(spark, 500)
    paths = []
    for k in range(5):
        paths.append(str(tmp_path / f"m{k}"))
        storage.write_segment(df.where(F.col("flow_id") % 5 == k), paths[-1])
    assert storage.compact(spark, paths, str(tmp_path / "h")) == 500
    assert storage.scan(spark, []).count() == 0
    aged = aggregate_flows(df)
    assert aged.count() < 500 and aged.agg(F.sum("flow_count"), F.sum("octets")).first() == (500, 500_000)
    m = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "path string, n_rows bigint")
    f = spark.createDataFrame([("a", 1), ("b", 9), ("d", 1)], "path string, n_rows bigint")
    assert {r.path: r.status for r in storage.verify_manifest(m, f).collect()} == {"a": "ok", "b": "corrupt", "c": "missing", "d": "orphan"}
    plan = storage.retention_plan(spark.createDataFrame([("flows", i, i, 10) for i in range(10)], "kind string, segment int, start_ts bigint, bytes bigint"), {"flows": 80})
    assert sorted(r.segment for r in plan.collect()) == [0, 1, 2]


def test_rollup_stream_is_idempotent(spark, tmp_path):
    from tidewire.operators.rollups import minute_rollup
    from tidewire.streaming.pipeline import RollupSink

    src = str(tmp_path / "in")
    flows(spark, 40).repartition(4).write.parquet(src)
    sink = RollupSink(str(tmp_path / "out"))
    q = spark.readStream.schema(flows(spark, 1).schema).option("maxFilesPerTrigger", 1).parquet(src).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    sink(flows(spark, 40).where("false"), 10_000)
    assert sorted(map(tuple, sink.read(spark).collect())) == sorted(map(tuple, minute_rollup(flows(spark, 40)).collect()))


def test_ipfix_and_rule_streams(spark, tmp_path):
    from tidewire.operators import ipfix
    from tidewire.streaming.pipeline import ipfix_flows, sliding_rule

    src = str(tmp_path / "grams")
    ipfix.encode_flows(flows(spark, 40)).repartition(2).write.parquet(src)
    stream = ipfix_flows(spark.readStream.schema("source string, received_at bigint, payload binary").option("maxFilesPerTrigger", 1).parquet(src))
    q = stream.writeStream.format("memory").queryName("decoded").option("checkpointLocation", str(tmp_path / "c1")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select count(*) n from decoded where kind = 'flow'").first().n == 40
    rows = spark.createDataFrame([("a", T0 + i * S, i, str(i)) for i in range(10)], "k string, t bigint, i bigint, v string").repartition(1).sortWithinPartitions("t")
    rows.write.parquet(str(tmp_path / "r"))
    q = sliding_rule(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "r")), ["k"], "t", "v", "i", window=60 * S, threshold=5).writeStream.format("memory").queryName("alerts").option("checkpointLocation", str(tmp_path / "c2")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.id, r.distinct) for r in spark.sql("select * from alerts").collect()] == [(4, 5)]


def test_as_of_takes_the_latest_validity_that_still_holds(spark):
    """Against a search row by row; the first case is a short validity within a long one."""
    rng = random.Random(7)
    history = [("k", 0, 100, "A"), ("k", 10, 20, "B"), (None, 0, None, "N"), ("e", 5, 5, "empty")]
    for key in "xyz":
        for i in range(12):
            lo = rng.randrange(200)
            history.append((key, lo, rng.choice([None, lo + rng.randrange(1, 90)]), f"{key}{i}"))
    facts = [(i, key, rng.randrange(-5, 260)) for i, key in enumerate([*"xyz" * 40, "k", None, "other", "e"])] + [(900, "k", 50), (901, "k", 10), (902, "k", 20), (903, "k", 100), (904, "k", 15)]
    want = {}
    for i, key, t in facts:
        held = [(lo, v) for k, lo, hi, v in history if k is not None and k == key and lo <= t and (hi is None or hi > t)]
        want[i] = max(held)[1] if held else None
    f, h = spark.createDataFrame(facts, "i int, k string, t bigint"), spark.createDataFrame(history, "k string, valid_from bigint, valid_to bigint, v string")
    assert (want[900], want[904], want[903]) == ("A", "B", None)
    for width in (1000, 7):
        got = E.as_of(f, h, "k", "t", value="v", width=width).collect()
        assert len(got) == len(facts) and {r.i: r.v for r in got} == want
    assert E.as_of(f.where("false"), h, "k", "t", value="v").columns == ["i", "k", "t", "v"]


def test_as_of_broadcasts_no_history(spark, tmp_path):
    """A small history file becomes many rows in buckets, which must not be gathered in the driver."""
    spark.range(50).selectExpr("id as k", "0L as valid_from", "cast(null as bigint) as valid_to", "id as v").write.parquet(f"{tmp_path}/h")
    spark.range(400).selectExpr("id as i", "id % 50 as k", "id * 100 as t").write.parquet(f"{tmp_path}/f")
    got = E.as_of(spark.read.parquet(f"{tmp_path}/f"), spark.read.parquet(f"{tmp_path}/h"), "k", "t", value="v", width=10)
    assert {(r.k, r.v) for r in got.collect()} == {(k, k) for k in range(50)}
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_metadata_store(spark, tmp_path):
    from tidewire.operators.filters import RecordFilter
    from tidewire.sources.metadata import MetadataStore, clients_like

    store = MetadataStore(spark, str(tmp_path / "meta"))
    assert store.read("clients").count() == 0 and store.segment_count() == 0
    store.add_suppression("a", rule="beaconing", expires_at=10)
    store.add_suppression("b", client_id=3)
    store.add_suppression("a", rule="beaconing", expires_at=20)
    assert {(r.id, r.expires_at) for r in store.suppressions().collect()} == {("a", 20), ("b", None)}
    assert [r.id for r in store.suppressions(now=30).collect()] == ["b"]
    store.remove_suppression("b")
    assert [r.id for r in store.suppressions().collect()] == ["a"] and len(store.versions("suppressions")) == 2
    store.expect("global", "*", "beacon", "1.1.1.1")
    store.expect("client", "7", "destination", "2.2.2.2")
    store.unexpect("global", "*", "beacon", "1.1.1.1")
    assert [(r.scope_value, r.value) for r in store.read("expectations").collect()] == [("7", "2.2.2.2")]
    store.configure("beaconing", enabled=False, min_count=5)
    store.configure("beaconing", min_count=6)
    config = store.rule_config()
    assert config.disabled == ("beaconing",) and config.get("beaconing", "min_count", 12) == 6
    clients = [(1, "Printer", "prn", "aa", False, "", 0, 5), (2, "Phone", None, None, False, None, 0, 9)]
    store.replace("clients", store._rows("clients", *[dict(zip("client_id label hostname mac trusted note first_seen last_seen".split(), c, strict=True)) for c in clients]))
    store.rename_client(2, "Tablet")
    store.trust_client(1)
    store.annotate_client(2, "mine")
    store.tag_client(1, "iot")
    store.tag_client(2, "iot")
    store.untag_client(2, "iot")
    view = E.clients_view(store.read("clients"), store.read("client_addresses"), store.read("client_tags"), store.read("tags"))
    assert [(r.label, r.trusted, r.tags) for r in view.collect()] == [("Tablet", False, None), ("Printer", True, "iot")]
    assert [r.client_id for r in clients_like(view, " IOT ").collect()] == [1] and clients_like(view, "").count() == 2
    store.save_search("web", "flows", RecordFilter(ports=(80, 443), text="x"), 5)
    store.save_search("web", "flows", RecordFilter(ports=(443,)), 6)
    store.save_search("web", "events", RecordFilter(), 7)
    assert store.saved_searches("flows") == {"web": RecordFilter(ports=(443,))}
    assert store.read("saved_searches").where("view = 'flows'").first().created_at == 5
    store.forget_search("web", "flows")
    assert store.saved_searches("flows") == {}


def test_unfinished_versions_are_not_read(spark, tmp_path):
    from tidewire.sources.metadata import MetadataStore

    store = MetadataStore(spark, str(tmp_path / "meta"))
    store.add_suppression("a")
    broken = tmp_path / "meta" / "suppressions" / "v=2"
    broken.mkdir()
    (broken / "part-0.parquet").write_text("half")
    assert [r.id for r in store.suppressions().collect()] == ["a"]
    store.add_suppression("b")
    assert sorted(r.id for r in store.suppressions().collect()) == ["a", "b"]


def test_segment_life(spark, tmp_path):
    from tidewire.sources.metadata import MetadataStore

    store, root = MetadataStore(spark, str(tmp_path / "meta")), str(tmp_path / "segments")
    df = flows(spark, 300)
    for k in range(4):
        storage.write_segment(df.where(F.col("flow_id") % 4 == k), f"{root}/m{k}")
    (tmp_path / "segments" / "half").mkdir()
    assert storage.recover(store, root) == {"quarantined": [f"{root}/half"], "missing": [], "healed": [f"{root}/m{k}" for k in range(4)]}
    assert storage.recover(store, root) == {"quarantined": [], "missing": [], "healed": []}
    manifest = storage.footer_manifest(spark, [f"{root}/m0", f"{root}/m1"])
    seen = df.where("flow_id % 4 < 2").groupBy((F.col("flow_id") % 4).alias("m")).agg(F.count("*").alias("n"), F.min("start_time").alias("a"), F.max("end_time").alias("b"), F.min("dst_v4").alias("c"), F.max("dst_v4").alias("d")).orderBy("m").collect()
    assert [(r.n_rows, r.start_ts, r.end_ts, r.min_dst_v4, r.max_dst_v4) for r in manifest.orderBy("path").collect()] == [(r.n, r.a, r.b, r.c, r.d) for r in seen]
    merged = storage.merge_stats(manifest, []).first()
    assert (merged.n_rows, merged.start_ts, merged.max_dst_v4) == (150, min(r.a for r in seen), max(r.d for r in seen))
    assert storage.compact_and_swap(store, [f"{root}/m0", f"{root}/m1"], f"{root}/h0") == 150
    assert sorted((r.path, r.n_rows) for r in store.read("segments").collect()) == [(f"{root}/h0", 150), (f"{root}/m2", 75), (f"{root}/m3", 75)]
    assert store.segment_count("flows") == 3 and not (tmp_path / "segments" / "m0").exists()
    least = store.read("segments").agg(F.sum("bytes")).first()[0] - 1
    gone = storage.enforce_retention(store, {"flows": least})
    assert gone and store.segment_count() == 3 - len(gone) and all(not (tmp_path / "segments" / g.rsplit("/", 1)[1]).exists() for g in gone)
    import shutil

    left = store.read("segments").first().path
    shutil.rmtree(left)
    assert storage.recover(store, root)["missing"] == [left]


def test_folding_rollup_parts_changes_no_sum(spark, tmp_path):
    from tidewire.operators.rollups import minute_rollup
    from tidewire.streaming.pipeline import RollupSink

    sink, df = RollupSink(str(tmp_path / "r")), flows(spark, 60)
    for k in range(6):
        sink(df.where(F.col("flow_id") % 6 == k), k)
    want = sorted(map(tuple, minute_rollup(df).collect()))
    assert sorted(map(tuple, sink.read(spark).collect())) == want
    assert sink.compact(spark, keep=2) == 4 and sorted(map(tuple, sink.read(spark).collect())) == want
    sink(df.where("flow_id % 6 = 1"), 1)  # a part that is folded already, written once more
    assert sorted(map(tuple, sink.read(spark).collect())) == want
    assert sink.compact(spark, keep=0) == 2 and sorted(map(tuple, sink.read(spark).collect())) == want


def test_tools(spark):
    from tidewire.operators.rollups import minute_rollup
    from tidewire.operators.tools import Toolbox

    f = flows(spark)
    events = spark.createDataFrame([(1, 0, T0 + 5 * S, 2, 2, 1)], "event_id bigint, origin smallint, received_at bigint, event_type int, action int, severity int")
    clients = spark.createDataFrame([(7, "Printer", 5), (8, "Phone", 9)], "client_id bigint, label string, last_seen bigint")
    alerts = spark.createDataFrame([("a", "open", 7, 5), ("b", "resolved", 8, 6)], "dedupe_key string, state string, client_id bigint, last_occurrence bigint")
    box = Toolbox(f, events, minute_rollup(f), clients, alerts, T0 + 500 * S)
    run = lambda name, **a: json.loads(box.run(name, json.dumps(a)))
    over = run("get_network_overview")
    assert over["totals"]["flows"] == 50 and over["destinations"][0]["k"] == "203.0.113.9" and over["events"] == [{"k": "2", "n": 1}]
    page = run("query_flows", client_id=7, limit=3, sort="recent")
    assert page["more"] and [r["flow_id"] for r in page["flows"]] == [48, 46, 44]
    assert run("query_flows", ip="203.0.113.9", direction="inbound")["count"] == 0
    assert len(run("top_talkers", dimension="dst_ip", limit=500)["rows"]) == 41
    assert [c["client_id"] for c in run("list_clients")["clients"]] == [8, 7]
    assert [a["dedupe_key"] for a in run("list_alerts")["alerts"]] == ["a"] and len(run("list_alerts", state="all")["alerts"]) == 2
    assert sum(b["flows"] for b in run("bandwidth_time_series", buckets=2)["buckets"]) == 50
    assert "error" in run("top_talkers") and "error" in run("no_such") and "error" in run("top_talkers", dimension="x") and "error" in json.loads(box.run("query_flows", "[1]")) and "error" in json.loads(box.run("query_flows", "{"))


def test_state_of_silent_keys_goes(spark, tmp_path):
    from tidewire.streaming.pipeline import sliding_rule

    src = tmp_path / "r"
    ddl = "k string, t bigint, i bigint, v string"
    src.mkdir()
    out = sliding_rule(spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(src)), ["k"], "t", "v", "i", window=60 * S, threshold=2, delay="1 second")
    spark.createDataFrame([("a", T0 + i * S, i, str(i)) for i in range(3)], ddl).coalesce(1).write.mode("append").parquet(str(src))
    q = out.writeStream.format("memory").queryName("silent").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    for k in range(1, 4):
        q.processAllAvailable()
        spark.createDataFrame([("b", T0 + k * 1000 * S, 100 + k, "x")], ddl).coalesce(1).write.mode("append").parquet(str(src))
    q.processAllAvailable()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    q.stop()
    assert [r.id for r in spark.sql("select * from silent").collect()] == [1] and held[-1] == 1
