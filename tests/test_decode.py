"""Syslog families, IPFIX decoding with state, capture files, framing."""

import random

import pytest

from tidewire.operators import ipfix as X
from tidewire.operators import syslog as Y
from tidewire.sources import capture

AT = 1_789_061_723_000_000


def parse(spark, line):
    return Y.parse(spark.createDataFrame([(line, AT, "10.0.0.1")], "raw string, received_at bigint, source_ip string")).first()


def test_rfc5424_with_structured_data(spark):
    r = parse(spark, '<165>1 2026-09-10T11:14:15.003Z gw.example app 77 ID47 [x@1 a="1" b="q\\"z"] hello world')
    assert (r.facility, r.severity, r.hostname, r.app_name, r.proc_id, r.msg_id) == (20, 5, "gw.example", "app", "77", "ID47")
    assert r.structured_data == {"x@1": {"a": "1", "b": 'q"z'}} and r.message == "hello world" and r.parse_status == 1


def test_rfc3164_year_is_the_nearest(spark):
    r = parse(spark, "<13>Dec 31 23:59:59 gw cron[5]: tick")
    assert r.hostname == "gw" and r.app_name == "cron" and r.proc_id == "5" and r.message == "tick"
    assert r.event_time == 1_798_761_599_000_000  # 2026-12-31, nearer than 2025's


def test_netfilter(spark):
    r = parse(spark, "<4>Sep 10 10:00:00 gw kernel: [WAN_LOCAL-D-4001]IN=eth0 OUT= MAC=aa:bb:cc:dd:ee:ff:11:22:33:44:55:66:08:00 SRC=203.0.113.9 DST=192.0.2.1 LEN=40 PROTO=TCP SPT=4444 DPT=22 SYN")
    assert (r.event_type, r.src_ip, r.dst_ip, r.src_port, r.dst_port, r.protocol, r.action) == (1, "203.0.113.9", "192.0.2.1", 4444, 22, 6, 2)
    assert r.rule_id == "4001" and r.in_iface == "eth0" and r.mac == "11:22:33:44:55:66" and r.parse_status == 2


def test_suricata_ssh_dns_dhcp_cef(spark):
    r = parse(spark, "<4>Sep 10 10:00:00 gw suricata[9]: [1:2001219:20] ET SCAN Potential SSH Scan [**] [Classification: Attempted Leak] [Priority: 2] {TCP} 198.51.100.7:5555 -> 192.0.2.5:22")
    assert (r.event_type, r.ids_signature_id, r.ids_severity, r.src_port, r.dst_port) == (2, "2001219", 2, 5555, 22)
    r = parse(spark, "<38>Sep 10 10:00:00 gw sshd[1]: Failed password for invalid user bob from 198.51.100.7 port 5022 ssh2")
    assert (r.event_type, r.username, r.src_ip, r.action) == (3, "bob", "198.51.100.7", 2)
    r = parse(spark, "<30>Sep 10 10:00:00 gw dnsmasq[1]: query[AAAA] example.org from 192.168.1.5")
    assert (r.event_type, r.query, r.query_type, r.src_ip) == (5, "example.org", "AAAA", "192.168.1.5")
    r = parse(spark, "<30>Sep 10 10:00:00 gw dnsmasq-dhcp[1]: DHCPACK(br0) 192.168.1.20 02:00:00:AA:bb:01 phone")
    assert (r.event_type, r.src_ip, r.mac, r.client_name) == (4, "192.168.1.20", "02:00:00:aa:bb:01", "phone")
    r = parse(spark, "<12>Sep 10 10:00:00 gw CEF:0|Acme|GW|1.0|201|Threat blocked|7|src=198.51.100.9 dst=192.0.2.8 spt=12 dpt=80 act=blocked msg=two words cat=IPS")
    assert (r.event_type, r.src_ip, r.dst_port, r.action, r.ids_signature) == (2, "198.51.100.9", 80, 2, "Threat blocked")


@pytest.mark.parametrize("line", ["", "garbage", "<999>x", "<13>", "<34>1 - - - - - -", "\x00\x01\x02", "CEF:0|a|b", "x" * 20000])
def test_nothing_fails(spark, line):
    assert parse(spark, line).raw == line


def test_framing():
    assert Y.frames(b"5 hello3 abcrest\r\nmore") == ([b"hello", b"abc", b"rest"], b"more")
    assert Y.frames(b"12 half") == ([], b"12 half")


def record(i, octets=100):
    return X.flow_record(3232260895, 3405803785, 40000 + i, 443, 6, 2, 3, octets, 1_789_000_000_000 + i, 1_789_000_001_000 + i)


def test_template_then_data():
    d = X.Decoder()
    rows = list(d.decode(X.message([X.template_set(), X.data_set([record(0), record(1)])], 0, 1_789_000_002), AT))
    flows = [r for r in rows if r["kind"] == "flow"]
    assert len(flows) == 2 and flows[0]["src_ip"] == "192.168.99.31" and flows[0]["octets"] == 100


def test_data_before_template_is_held_and_state_survives():
    d = X.Decoder()
    first = list(d.decode(X.message([X.data_set([record(0)])], 0, 1_789_000_002), 1_789_000_002_000_000))
    assert [r["event"] for r in first if r["kind"] == "event"] == ["missing-template"]
    d = X.Decoder(X.State.load(d.state.dump()))
    later = list(d.decode(X.message([X.template_set()], 1, 1_789_000_003), 1_789_000_003_000_000))
    held = [r for r in later if r["kind"] == "flow"]
    assert len(held) == 1 and held[0]["received_at"] == 1_789_000_002_000_000


def test_sequence_gap_and_restart():
    d = X.Decoder()
    now = 1_789_000_002
    list(d.decode(X.message([X.template_set(), X.data_set([record(0)])], 10, now), now * 10**6))
    assert "sequence-gap" in [r.get("event") for r in d.decode(X.message([X.data_set([record(1)])], 20, now), now * 10**6)]
    assert "restart" in [r.get("event") for r in d.decode(X.message([X.data_set([record(2)])], 0, now), now * 10**6)]


def test_mutations_never_raise():
    rng = random.Random(3)
    base = X.message([X.template_set(), X.data_set([record(i) for i in range(3)])], 0, 1_789_000_002)
    for _ in range(1500):
        raw = bytearray(base)
        for _ in range(rng.randrange(1, 6)):
            raw[rng.randrange(len(raw))] = rng.randrange(256)
        rows = list(X.Decoder().decode(bytes(raw[: rng.randrange(len(raw) + 1)]), AT))
        assert all(r["end_time"] >= r["start_time"] for r in rows if r["kind"] == "flow")


def test_capture_round_trip(spark, tmp_path):
    rows = [(AT + i, "syslog" if i % 2 else "flow", 0, "10.0.0.1" if i % 2 else "2001:db8::1", 5, 514, bytes([i] * i)) for i in range(5)]
    data = capture.MAGIC + b"".join(capture.encode(*r) for r in rows)
    assert list(capture.records(data[:-1])) == rows[:-1]
    (tmp_path / "a.nsraw").write_bytes(data)
    got = sorted(tuple(r) for r in capture.read_capture(spark, str(tmp_path)).collect())
    assert [(r[0], bytes(r[6])) for r in got] == [(r[0], r[6]) for r in rows]
