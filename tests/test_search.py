"""Record search, top lists, series and rollups on a small store with known counts."""

import pytest
from pyspark.sql import functions as F

from tidewire.operators import rollups as R
from tidewire.operators import search as S
from tidewire.operators.filters import EVENTS, RecordFilter, compile_filter

T0 = 1_788_998_400 * 1_000_000
HOUR = 3_600_000_000


def v4(ip):
    a, b, c, d = map(int, ip.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


@pytest.fixture(scope="module")
def flows(spark):
    rows = []
    for h in range(3):
        for i in range(600):
            t = T0 + h * HOUR + i * 5_000_000
            src, dst = f"192.168.99.{10 + i % 10}", f"203.0.113.{h * 50 + i % 50}"
            if i % 4 == 0:
                src, dst = dst, src
            rows.append((h * 1000 + i, 0, t, t + 1_000_000, src, dst, v4(src), v4(dst), 40000 + i, *((53, 17) if i % 3 == 0 else (443, 6)), 10, 1000 + i, 2 if i % 4 == 0 else 1, "US" if i % 2 == 0 else "DE", 5 if i % 4 else None, 6 if i % 4 == 0 else None, h))
    ddl = "flow_id bigint, origin smallint, start_time bigint, end_time bigint, src_ip string, dst_ip string, src_v4 bigint, dst_v4 bigint, src_port int, dst_port int, protocol int, packets bigint, octets bigint, direction int, dst_country string, src_client_id bigint, dst_client_id bigint, segment int"
    return spark.createDataFrame(rows, ddl).withColumn("flow_count", F.lit(1).cast("bigint")).cache()


@pytest.fixture(scope="module")
def events(spark):
    rows = []
    for h in range(3):
        for i in range(100):
            auth = i % 5 == 0
            rows.append((h * 1000 + i, 0, T0 + h * HOUR + i * 30_000_000, None, 3 if auth else 1, 4 if auth else 6, None if auth else 2, "Failed password for root" if auth else f"kernel line {i}", f"203.0.113.{i}", "192.168.99.1", f"WAN_LOCAL-D-{4000 + i % 3}", None))
    return spark.createDataFrame(rows, "event_id bigint, origin smallint, received_at bigint, event_time bigint, event_type int, severity int, action int, message string, src_ip string, dst_ip string, rule_name string, hostname string").cache()


def test_pages_do_not_repeat_and_cover(flows):
    f, seen, cursor = RecordFilter(any_ip="192.168.99.12"), [], None
    while True:
        rows = S.page(flows, f, limit=50, after=cursor).collect()
        seen += [r.flow_id for r in rows]
        cursor = S.next_cursor(rows, 50)
        if cursor is None:
            break
    assert len(seen) == 180 and len(set(seen)) == 180


@pytest.mark.parametrize("sort", ["octets", "src_ip", "duration", "dst_port"])
def test_concatenated_pages_equal_a_full_sort(flows, sort):
    f = RecordFilter(directions=(1,))
    whole = [r.flow_id for r in S.page(flows, f, sort=sort, descending=False, limit=10_000).collect()]
    first = S.page(flows, f, sort=sort, descending=False, limit=700).collect()
    second = S.page(flows, f, sort=sort, descending=False, limit=10_000, after=S.next_cursor(first, 700, sort=sort)).collect()
    assert whole == [r.flow_id for r in first + second]


def test_filters(flows):
    n = lambda f: flows.where(compile_filter(f)).count()
    assert n(RecordFilter(start=T0 + HOUR, end=T0 + 2 * HOUR - 1, ports=(53,), protocols=(17,))) == 200
    assert n(RecordFilter(directions=(2,), countries=("US",))) == 450
    assert n(RecordFilter(prefix="203.0.113.0/24", min_octets=1500)) == 300
    assert n(RecordFilter(prefix="2001:db8::/32")) == 0
    assert n(RecordFilter(start=1_000_000, end=2_000_000)) == 0


def test_event_search(events):
    n = lambda f: S.page(events, f, EVENTS, limit=10_000, numeric=False).count()
    assert n(RecordFilter(event_types=(3,))) == 60
    assert n(RecordFilter(text="PASSWORD")) == 60
    assert n(RecordFilter(text="') OR 1=1 --")) == 0
    rules = S.event_counts(events, RecordFilter(), "rule_name").collect()
    assert len(rules) == 3 and sum(r.n for r in rules) == 300
    with pytest.raises(ValueError):
        S.event_counts(events, RecordFilter(), "message; drop table")


def test_top_and_series(flows):
    top = S.top_n(flows, RecordFilter(), "dst_port").collect()
    assert [r.k for r in top] == ["443", "53"] and sum(r.flows for r in top) == 1800
    scan = S.time_series(flows, RecordFilter(), HOUR).collect()
    assert [r.flows for r in scan] == [600, 600, 600]
    assert all(r.inbound + r.outbound == r.bytes for r in scan)
    minutes = R.minute_rollup(flows)
    assert S.series(flows, minutes, RecordFilter(), HOUR).collect() == scan
    assert S.totals(minutes, RecordFilter()).first().flows == 1800
    assert S.totals(minutes, RecordFilter(start=1, end=2)).first().flows == 0


def test_pruning(flows):
    from tidewire.sources.storage import candidate_segments, segment_manifest

    m = segment_manifest(flows, "segment", "start_time", "end_time", ["src_v4", "dst_v4", "dst_port"])
    n = lambda f: candidate_segments(m, f).count()
    assert n(RecordFilter(start=T0 + HOUR, end=T0 + HOUR + HOUR // 2)) == 1
    assert n(RecordFilter(ports=(8080,))) == 0
    assert n(RecordFilter()) == 3


def test_rollup_merge_is_additive_and_days_cascade(flows):
    m = R.minute_rollup(flows)
    twice = R.merge_minutes(m, m)
    assert twice.agg(F.sum("bytes")).first()[0] == 2 * m.agg(F.sum("bytes")).first()[0]
    hours = R.merge_hours(R.hour_rollup(flows.withColumn("dst_asn", F.lit(None).cast("bigint"))))
    days = R.day_rollup(hours)
    assert days.agg(F.sum("flows")).first()[0] == 1800
    assert R.days_without_summary(days, days.select("day", "origin").distinct()).count() == 0
    assert '"top_ports"' in R.daily_summary(m, days).first().summary


def test_newest_country_that_is_known_wins(spark):
    part = lambda seq, country: spark.createDataFrame([(0, 0, 0, "a", 1, 6, 1, country, None, 1, 1, 1, 0, seq)], "bucket bigint, origin smallint, client_id bigint, dst_ip string, dst_port int, protocol int, direction int, dst_country string, dst_asn bigint, flows bigint, packets bigint, bytes bigint, denied bigint, seq int")
    merged = R.merge_hours(part(0, "DE"), part(1, "US"), part(2, None)).first()
    assert merged.dst_country == "US" and merged.flows == 3
