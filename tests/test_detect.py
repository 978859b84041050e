"""Rules fire on the positive case and stay silent on the control; folds agree with plain Python."""

import random

from pyspark.sql import functions as F

from tidewire.operators import alerts as A
from tidewire.operators import detect as D

T = 1_789_000_000 * 1_000_000
S = 1_000_000
DDL = "flow_id bigint, start_time bigint, end_time bigint, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, octets bigint, packets bigint, src_client_id bigint, direction int, dst_country string, dst_asn bigint, sampling_interval bigint, src_vlan int, dst_vlan int"


def flow(i=0, t=None, **k):
    base = dict(flow_id=1000 + i, start_time=T + i * S, src_ip="192.168.99.31", dst_ip="203.0.113.9", src_port=40000, dst_port=443, protocol=6, octets=5000, packets=10, src_client_id=7, direction=1, dst_country="DE", dst_asn=3320, sampling_interval=1, src_vlan=None, dst_vlan=None)
    base.update(k)
    if t is not None:
        base["start_time"] = t
    base.setdefault("end_time", base["start_time"] + 100_000)
    return base


def frame(spark, rows):
    names = [c.split()[0] for c in DDL.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], DDL)


def expected(spark, *rows):
    return spark.createDataFrame(rows, "scope_value string, kind string, value string")


def test_horizontal_scan(spark):
    rows = [flow(i, dst_ip=f"198.51.100.{i}", dst_port=445, packets=1) for i in range(30)]
    hits = D.port_scan(frame(spark, rows)).collect()
    assert len(hits) == 1 and hits[0].evidence["distinct"] == "25" and hits[0].severity == D.HIGH
    assert D.port_scan(frame(spark, [{**r, "packets": 500} for r in rows])).count() == 0


def test_vertical_scan(spark):
    rows = [flow(i, dst_port=1000 + i, packets=1) for i in range(25)]
    assert [h.evidence["distinct"] for h in D.port_scan(frame(spark, rows), horizontal=False).collect()] == ["20"]
    slow = [flow(i, dst_port=1000 + i, packets=1, start_time=T + i * 120 * S) for i in range(25)]
    assert D.port_scan(frame(spark, slow), horizontal=False).count() == 0


def test_large_transfer(spark):
    hit = D.large_transfer(frame(spark, [flow(octets=3_000_000, sampling_interval=512)])).collect()
    assert len(hit) == 1 and hit[0].evidence["bytes"] == "1536000000"
    assert D.large_transfer(frame(spark, [flow(i, octets=1_000_000) for i in range(50)])).count() == 0
    later = [flow(octets=3_000_000, sampling_interval=512), flow(1, t=T + 7200 * S, octets=3_000_000, sampling_interval=512)]
    assert len({h.dedupe_key for h in D.large_transfer(frame(spark, later)).collect()}) == 2  # a window each
    assert D.large_transfer(frame(spark, later), expectations=expected(spark, ("7", "destination", "203.0.113.9"))).count() == 0
    assert D.large_transfer(frame(spark, later), expectations=expected(spark, ("*", "destination", "203.0.113.9"))).count() == 2


def test_beacon(spark):
    rows = [flow(i, start_time=T + i * 60 * S, octets=900) for i in range(15)]
    hits = D.beaconing(frame(spark, rows)).collect()
    assert len(hits) == 1 and hits[0].evidence["count"] == "12"
    rng = random.Random(1)
    odd = [flow(i, start_time=T + (i * 60 + rng.randrange(55)) * S, octets=900) for i in range(15)]
    assert D.beaconing(frame(spark, odd)).count() == 0
    assert D.beaconing(frame(spark, [{**r, "octets": 5_000_000} for r in rows])).count() == 0
    assert D.beaconing(frame(spark, rows), expectations=expected(spark, ("*", "beacon", "203.0.113.9"))).count() == 0
    assert D.beaconing(frame(spark, rows), expectations=expected(spark, ("7", "destination", "203.0.113.9"))).count() == 0
    assert D.beaconing(frame(spark, rows), expectations=expected(spark, ("*", "destination", "203.0.113.9"))).count() == 1
    # It fires again at the end of the cool-down, not only after it.
    long = [flow(i, start_time=T + i * 600 * S, octets=900) for i in range(24)]
    assert sorted((h.at - T) // (600 * S) for h in D.beaconing(frame(spark, long)).collect()) == [11, 23]


def test_first_seen(spark):
    day = 86_400 * S
    rows = [flow(0, t=T), flow(1, t=T + 4 * day), flow(2, t=T + 4 * day + S, dst_ip="198.51.100.5", octets=50_000), flow(3, t=T + 4 * day + 2 * S, dst_ip="198.51.100.6", octets=10)]
    hits = D.first_seen(frame(spark, rows), "first-seen-destination").collect()
    assert [h.subject for h in hits] == ["198.51.100.5"]
    known = expected(spark, ("7", "dst_ip", "198.51.100.5"))
    assert D.first_seen(frame(spark, rows), "first-seen-destination", expectations=known).count() == 0
    known = D.first_seen_table(frame(spark, rows))
    assert D.first_seen(frame(spark, rows), "first-seen-destination", known=known).count() == 0


def test_resolver_and_vlan(spark):
    rows = [flow(0, dst_ip="8.8.8.8", dst_port=53, protocol=17), flow(1, dst_ip="9.9.9.9", dst_port=853), flow(2, dst_ip="1.1.1.1", dst_port=53)]
    assert D.unauthorized_resolver(frame(spark, rows), ["1.1.1.1"]).count() == 2
    assert D.unauthorized_resolver(frame(spark, rows), []).count() == 0
    lan = [flow(0, direction=3, src_vlan=20, dst_vlan=99, dst_ip="192.168.99.5"), flow(1, direction=3, src_vlan=99, dst_vlan=99)]
    assert [(h.subject, h.dedupe_key) for h in D.vlan_crossing(frame(spark, lan)).collect()] == [("vlan20<->vlan99", "unexpected-vlan-communication|vlan20<->vlan99|192.168.99.31|192.168.99.5|443")]
    back = [flow(2, direction=3, src_vlan=99, dst_vlan=20, src_ip="192.168.99.5", dst_ip="192.168.99.31")]
    for known in (("*", "vlan-pair", "vlan20<->vlan99"), ("vlan20", "peer-vlan", "vlan99"), ("vlan99", "peer-vlan", "vlan20")):
        assert D.vlan_crossing(frame(spark, lan + back), expectations=expected(spark, known)).count() == 0
    bare = [flow(3, direction=3, src_ip="192.168.1.7", dst_ip="10.9.0.1"), flow(4, direction=3, src_ip="192.168.1.7", dst_ip="172.16.0.1"), flow(5, direction=3, src_ip="192.168.1.7", dst_ip="192.168.1.8")]
    assert [h.subject for h in D.vlan_crossing(frame(spark, bare), prefixes=["192.168.0.0/16", "10.0.0.0/8"]).collect()] == ["10.0.0.0/8<->192.168.0.0/16"]


def test_cool_down_fold_equals_plain_python(spark):
    rng = random.Random(5)
    rows, t = [], T
    for i in range(300):
        t += rng.choice([1, 5, 20, 90]) * S
        rows.append((rng.choice("ab"), t, i, str(rng.randrange(8))))
    got = D.sliding_distinct(spark.createDataFrame(rows, "k string, t bigint, i bigint, v string"), ["k"], "t", "v", "i", window=60 * S, threshold=3).collect()
    want = []
    for key in "ab":
        seen, last = {}, None
        for k, t, i, v in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            seen = {x: s for x, s in seen.items() if s >= t - 60 * S}
            seen[v] = t
            if len(seen) >= 3 and (last is None or t - last > 60 * S):
                last = t
                want.append((k, t, i, len(seen)))
    assert sorted((r.k, r.at, r.id, r.distinct) for r in got) == sorted(want)


def test_a_key_that_never_pauses(spark, monkeypatch):
    """One key, more rows than an Arrow batch, no pause as long as the window: spans and counts equal plain Python."""
    rng = random.Random(8)
    rows, t = [], 0
    for i in range(5000):
        t += rng.choice([0, 1, 2, 9])
        rows.append(("k", t, i, str(rng.randrange(30))))
    df = spark.createDataFrame(rows, "k string, t bigint, i bigint, v string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        for at_end in (False, True):
            want, last = [], None
            for _, t, i, _ in rows:
                if last is None or t - last > 50 or (at_end and t - last >= 50):
                    last = t
                    want.append(i)
            got = D.opened(df, ["k"], "t", "i", 50, at_end=at_end).collect()
            assert sorted(r.i for r in got if r._opens) == want and len(got) == len(rows)
        counts = {r.i: r.distinct for r in D.trailing_distinct(df, ["k"], "t", "v", "i", 50).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for a, (_, t, i, _) in enumerate(rows):
        assert counts[i] == len({v for _, s, _, v in rows[max(0, a - 60) : a + 1] if s >= t - 50}), i


def test_a_rule_that_fails_while_it_runs_does_not_stop_the_others(spark):
    from pyspark.sql import functions as F

    f = frame(spark, [flow(i, dst_ip=f"198.51.100.{i}", dst_port=445, packets=1) for i in range(30)])
    broken = f.withColumn("packets", F.raise_error(F.lit("bad row")).cast("bigint"))
    stats = D.run_rules({"a": D.port_scan(broken), "b": D.port_scan(f)}, lambda rule, found: len(found.collect()))
    assert "bad row" in stats["a"]["error"] and (stats["b"]["findings"], stats["b"]["error"]) == (1, None) and stats["b"]["seconds"] > 0


def test_alert_life(spark):
    rows = [flow(i, dst_ip=f"198.51.100.{i}", dst_port=445, packets=1) for i in range(30)]
    found = D.port_scan(frame(spark, rows))
    alerts = A.deduplicate(found)
    again = A.deduplicate(found, alerts).collect()
    assert [(a.occurrences, a.state) for a in again] == [(2, "open")]
    resolved = A.set_state(alerts, again[0].dedupe_key, A.RESOLVED, T)
    reopened = A.deduplicate(found, resolved)
    assert sorted(r.state for r in reopened.collect()) == ["open", "resolved"]
    quiet = spark.createDataFrame([("port-scan-horizontal", None, None, None, None, None)], "rule string, client_id bigint, subject string, hour_from int, hour_to int, expires_at bigint")
    assert A.suppress(found, quiet).count() == 0
    assert {r.state: r["count"] for r in A.counts_by_state(reopened).collect()} == {"open": 1, "resolved": 1}


def test_one_broken_rule_does_not_stop_the_others(spark):
    events = spark.createDataFrame([], "event_id bigint")
    history = spark.createDataFrame([], "client_id bigint, hour bigint, bytes bigint, flows bigint")
    out, failed = D.evaluate(frame(spark, [flow()]), events, history=history, config=D.RuleConfig(disabled=("beaconing",)))
    assert "repeated-denials" in failed and "ids-event" in failed
    assert "port-scan-horizontal" in out and "beaconing" not in out


def test_order_statistics(spark):
    from pyspark.sql import functions as F

    m, p = D.order_statistics(F.col("v"))
    r = spark.createDataFrame([([4, 1, 3, 2],)], "v array<bigint>").select(m.alias("m"), p.alias("p")).first()
    assert (r.m, r.p) == (3, 4)


def test_prefixes_are_found_by_the_addresses_given(spark, tmp_path):
    """The registered pairs place sources by their last octet, as their SQL does, also where there are more than 256 of them."""
    import duckdb

    from tidewire.plans import registry

    lines = ", ".join(f"({n}, 1, 300, {supplier}, 5.0, 90000.0, 'O', 'N', TIMESTAMP '1995-03-0{1 + n}')" for n, supplier in enumerate([5, 200, 261, 456]))
    with duckdb.connect() as db:
        db.sql("SET TimeZone = 'UTC'")
        db.sql(f"CREATE VIEW lineitem AS SELECT l_orderkey::BIGINT AS l_orderkey, l_linenumber, l_partkey::BIGINT AS l_partkey, l_suppkey::BIGINT AS l_suppkey, l_quantity::DOUBLE AS l_quantity, l_extendedprice::DOUBLE AS l_extendedprice, l_linestatus, l_returnflag, l_shipdate FROM (VALUES {lines}) t(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_linestatus, l_returnflag, l_shipdate)")
        db.sql("CREATE VIEW nation AS SELECT 0::BIGINT AS n_nationkey, 'N' AS n_name, 0::BIGINT AS n_regionkey")
        for name in ("lineitem", "nation"):
            db.sql(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
        want = db.sql(registry.ORACLE_SQL["prefix_pairs"]).fetchall()
    got = [tuple(r) for r in registry.QUERIES["prefix_pairs"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(got) == 2
    bare = frame(spark, [flow(0, direction=3, src_ip="10.0.1.5", dst_ip="203.0.0.9")])
    prefixes = ["10.0.0.0/25", "203.0.0.0/16"]
    assert D.vlan_crossing(bare, prefixes=prefixes).count() == 0
    assert D.vlan_crossing(bare, prefixes=prefixes, located=(F.lit("10.0.0.5"), F.col("dst_ip"))).count() == 1
