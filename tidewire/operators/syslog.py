"""Syslog lines to events. Header, families and fields are JVM regular expressions over one scan; nothing
shuffles. A pattern runs once for a line, whose groups are then fields of an array, and a family's pattern only on the lines
that it claims. What no family claims stays as it is, marked as partly parsed (header only) or not parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNPARSED, PARTIAL, PARSED = 0, 1, 2
MAX_BYTES = 8192

# Header patterns of RFC 5424 and RFC 3164, and month names.
RFC5424 = r"^1 (\S+) (\S+) (\S+) (\S+) (\S+) (-|(?:\[(?:[^\]\\\"]|\\.|\"(?:[^\"\\]|\\.)*\")*\])+)(?: (.*))?$"
RFC3164 = r"^(?:([A-Z][a-z]{2}) +(\d{1,2}) (\d{2}:\d{2}:\d{2})|(\d{4}-\d\d-\d\dT\S+)) (\S+) (.*)$"
TAG = r"^([^\s:\[\]]{1,48})(?:\[([^\]]*)\])?: ?(.*)$"
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def _rx(c: Column, pattern: str, group: int) -> Column:
    """The group, or null where the pattern does not match or the group is empty."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def _groups(c: Column, pattern: str, n: int) -> Column:
    """All groups of the first match as an array, of empty texts where a group took no part; null where nothing matches."""
    found = F.regexp_extract(c, pattern, 0)
    return F.when(found != "", F.split(F.regexp_replace(found, pattern, "\u0001".join(f"${i}" for i in range(1, n + 1))), "\u0001"))


def _group(groups: Column, i: int) -> Column:
    """The group, or null where it is empty or there is none."""
    return F.nullif(F.get(groups, F.lit(i - 1)), F.lit(""))


def _tail(groups: Column, i: int) -> Column:
    """The last group, which may hold anything."""
    return F.array_join(F.slice(groups, i, F.greatest(F.size(groups) - i + 1, F.lit(0))), "\u0001")


def _once(df: DataFrame, **named: Column) -> DataFrame:
    """Columns that are computed once, whatever later uses them: the optimizer does not write a generator's fields into expressions."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in named.items()]))))


def _nil(c: Column) -> Column:
    return F.nullif(c, F.lit("-"))


def bsd_time(month: Column, day: Column, clock: Column, received: Column, zone: str = "UTC") -> Column:
    """Microseconds of a time without a year: the year, of the one received in and its neighbours, that is nearest."""
    m = F.array_position(F.array(*[F.lit(x) for x in MONTHS]), month).cast("int")
    year = F.year(F.from_utc_timestamp(F.timestamp_micros(received), zone))
    parts = F.split(clock, ":")

    def at(y: Column) -> Column:
        stamp = F.try_make_timestamp(y, m, day.cast("int"), parts[0].cast("int"), parts[1].cast("int"), parts[2].cast("double").cast("decimal(8,6)"))
        return F.unix_micros(F.to_utc_timestamp(stamp, zone))

    options = F.array(at(year - 1), at(year), at(year + 1))
    ranked = F.array_sort(F.transform(F.filter(options, lambda o: o.isNotNull()), lambda o: F.struct(F.abs(o - received).alias("d"), o.alias("t"))))
    return F.get(ranked, 0)["t"]


def structured_data(sd: Column) -> Column:
    """RFC 5424 structured data as a map of maps, escapes undone. Depends on nothing but the text."""
    elements = F.regexp_extract_all(sd, F.lit(r"\[((?:[^\]\\\"]|\\.|\"(?:[^\"\\]|\\.)*\")*)\]"), 1)

    def element(e):
        name = F.regexp_extract(e, r"^(\S+)", 1)
        keys = F.regexp_extract_all(e, F.lit(r"(\S+?)=\"((?:[^\"\\]|\\.)*)\""), 1)
        values = F.transform(F.regexp_extract_all(e, F.lit(r"(\S+?)=\"((?:[^\"\\]|\\.)*)\""), 2), lambda v: F.regexp_replace(v, r"\\([\\\"\]])", "$1"))
        return F.struct(name.alias("key"), F.map_from_arrays(keys, values).alias("value"))

    return F.when(sd.isNotNull() & (sd != "-"), F.map_from_entries(F.transform(elements, element)))


def key_values(text: Column) -> Column:
    """KEY=value words as a map; the last of equal keys stays, words without '=' are flags with an empty value."""
    pairs = F.transform(F.filter(F.split(text, r"\s+"), lambda w: w.rlike(r"^[A-Z][A-Z0-9_]*(=|$)")), lambda w: F.struct(F.regexp_extract(w, r"^([^=]+)", 1).alias("k"), F.regexp_extract(w, r"^[^=]+=?(.*)$", 1).alias("v")))
    # Of equal keys the last: a key is kept where no later pair has it.
    n = F.size(pairs)
    keys = F.transform(pairs, lambda p: p["k"])
    kept = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.greatest(n - i - 1, F.lit(0))), p["k"]))
    return F.map_from_entries(kept)


# Families: which messages one claims, what it takes out of a claimed one once, and its columns out of that. ------


def _netfilter(m: Column) -> Column:
    return m.rlike(r"\bIN=\S*") & m.rlike(r"\bSRC=\S+")


def _netfilter_parts(m: Column) -> Column:
    rule = F.coalesce(_rx(m, r"^\[([^\]]+)\]", 1), _rx(m, r"^([A-Za-z0-9_.\-]+)(?:\s|:)", 1))
    return F.struct(key_values(F.regexp_replace(m, r"^\[[^\]]*\]", "")).alias("kv"), rule.alias("rule"), F.upper(F.concat_ws(" ", rule, _rx(m, r"DESCR=\"([^\"]*)\"", 1))).alias("act"))


def _netfilter_fields(parts: Column) -> dict[str, Column]:
    rule, act = parts["rule"], parts["act"]
    get = lambda k: F.nullif(F.try_element_at(parts["kv"], F.lit(k)), F.lit(""))
    action = F.when(act.rlike(r"-D-|-D\b|DROP|DENY|BLOCK"), 2).when(act.rlike(r"-R-|-R\b|REJECT"), 3).when(act.rlike(r"-A-|-A\b|-RET-|ACCEPT|ALLOW"), 1)
    proto = get("PROTO")
    number = F.when(proto == "TCP", 6).when(proto == "UDP", 17).when(proto == "ICMP", 1).when(proto == "ICMPV6", 58).otherwise(proto.try_cast("int"))
    return {
        "parser_name": F.lit("netfilter"), "event_type": F.lit(1), "src_ip": get("SRC"), "dst_ip": get("DST"), "src_port": get("SPT").try_cast("int"), "dst_port": get("DPT").try_cast("int"), "protocol": number, "in_iface": get("IN"), "out_iface": get("OUT"),
        "rule_name": rule, "rule_id": _rx(rule, r"-(\d+)$", 1), "action": action, "mac": F.lower(F.nullif(F.substring(get("MAC"), 19, 17), F.lit(""))),
    }


_SURICATA = r"\[(\d+):(\d+):(\d+)\] (.*?) \[\*\*\](?: \[Classification: ([^\]]*)\])?(?: \[Priority: (\d+)\])? \{([A-Za-z0-9\-]+)\} (\S+?)(?::(\d+))? -> (\S+?)(?::(\d+))?$"


def _suricata(m: Column) -> Column:
    return m.rlike(_SURICATA)


def _suricata_parts(m: Column) -> Column:
    return F.struct(_groups(m, _SURICATA, 11).alias("g"), m.rlike(r"(?i)\[(drop|block)").alias("drop"))


def _suricata_fields(parts: Column) -> dict[str, Column]:
    g = lambda i: _group(parts["g"], i)
    proto = F.upper(g(7))
    return {
        "parser_name": F.lit("suricata"), "event_type": F.lit(2), "ids_signature_id": g(2), "ids_signature": g(4), "ids_category": g(5), "ids_severity": g(6).cast("int"),
        "protocol": F.when(proto == "TCP", 6).when(proto == "UDP", 17).when(proto == "ICMP", 1), "src_ip": g(8), "src_port": g(9).cast("int"), "dst_ip": g(10), "dst_port": g(11).cast("int"), "action": F.when(parts["drop"], 2).otherwise(5),
    }


_DHCP = r"^DHCP(DISCOVER|OFFER|REQUEST|ACK|NAK|RELEASE|INFORM|DECLINE)\((\S+?)\)(?: (\d+\.\d+\.\d+\.\d+))?(?: ([0-9a-fA-F:]{17}))?(?: (\S+))?"
_DNS = r"^(query|reply|cached|forwarded|config)(?:\[(\S+?)\])? (\S+) (?:from|is|to) (\S+)$"
_SSH = r"^(Accepted|Failed) (\S+) for (?:invalid user )?(\S*) from (\S+) port (\d+)"


def _dhcp(m: Column) -> Column:
    return m.rlike(_DHCP)


def _dhcp_parts(m: Column) -> Column:
    return F.struct(_groups(m, _DHCP, 5).alias("g"))


def _dhcp_fields(parts: Column) -> dict[str, Column]:
    g = lambda i: _group(parts["g"], i)
    return {"parser_name": F.lit("dnsmasq-dhcp"), "event_type": F.lit(4), "src_ip": g(3), "mac": F.lower(g(4)), "client_name": g(5), "in_iface": g(2)}


def _dns(m: Column) -> Column:
    return m.rlike(_DNS)


def _dns_parts(m: Column) -> Column:
    return F.struct(_groups(m, _DNS, 4).alias("g"))


def _dns_fields(parts: Column) -> dict[str, Column]:
    g = lambda i: _group(parts["g"], i)
    return {"parser_name": F.lit("dnsmasq-dns"), "event_type": F.lit(5), "query": g(3), "query_type": g(2), "src_ip": F.when(g(1) == "query", g(4))}


def _ssh(m: Column) -> Column:
    return m.rlike(_SSH)


def _ssh_parts(m: Column) -> Column:
    return F.struct(_groups(m, _SSH, 5).alias("g"))


def _ssh_fields(parts: Column) -> dict[str, Column]:
    g = lambda i: _group(parts["g"], i)
    return {"parser_name": F.lit("openssh"), "event_type": F.lit(3), "username": g(3), "src_ip": g(4), "src_port": g(5).cast("int"), "dst_port": F.lit(22), "action": F.when(g(1) == "Accepted", 1).otherwise(2), "method": g(2)}


_CEF = r"CEF:(\d+)\|((?:[^|\\]|\\.)*)\|((?:[^|\\]|\\.)*)\|((?:[^|\\]|\\.)*)\|((?:[^|\\]|\\.)*)\|((?:[^|\\]|\\.)*)\|((?:[^|\\]|\\.)*)\|(.*)$"


def cef_extension(ext: Column) -> Column:
    """key=value pairs whose values may hold blanks: a value ends before the next key."""
    keys = F.regexp_extract_all(ext, F.lit(r"(?:^|\s)([A-Za-z0-9_.]+)=((?:[^\\=]|\\.)*?)(?=\s+[A-Za-z0-9_.]+=|$)"), 1)
    values = F.transform(F.regexp_extract_all(ext, F.lit(r"(?:^|\s)([A-Za-z0-9_.]+)=((?:[^\\=]|\\.)*?)(?=\s+[A-Za-z0-9_.]+=|$)"), 2), lambda v: F.regexp_replace(v, r"\\([\\=|])", "$1"))
    return F.map_from_entries(F.arrays_zip(F.transform(F.array_distinct(keys), lambda k: k).alias("key"), F.transform(F.array_distinct(keys), lambda k: F.get(values, (F.array_position(keys, k) - 1).cast("int"))).alias("value")))


def _cef(m: Column) -> Column:
    return m.rlike(_CEF)


def _cef_parts(m: Column) -> Column:
    return F.struct(_groups(m, _CEF, 8).alias("g"), cef_extension(_rx(m, _CEF, 8)).alias("ext"))


def _cef_fields(parts: Column) -> dict[str, Column]:
    get = lambda k: F.try_element_at(parts["ext"], F.lit(k))
    g = lambda i: _group(parts["g"], i)
    name = F.regexp_replace(g(6), r"\\([\\|])", "$1")
    category = F.lower(F.concat_ws(" ", get("cat"), name))
    kind = F.when(category.rlike("intrusion|ids|ips|threat"), 2).when(category.rlike("firewall|blocked|policy"), 1).when(category.rlike("auth|login|admin"), 3).when(category.rlike("vpn"), 8).when(category.rlike("wifi|wireless|client"), 7).otherwise(9)
    risk = F.lower(g(7))
    severity = F.when(risk.isin("very-high", "9", "10"), 1).when(risk.isin("high", "7", "8"), 2).when(risk.isin("medium", "4", "5", "6"), 3).otherwise(4)
    act = F.lower(F.coalesce(get("act"), F.lit("")))
    return {
        "parser_name": F.lit("cef"), "event_type": kind, "src_ip": get("src"), "dst_ip": get("dst"), "src_port": get("spt").try_cast("int"), "dst_port": get("dpt").try_cast("int"), "username": F.coalesce(get("suser"), get("duser")), "rule_name": name, "rule_id": g(5), "device_id": get("dvchost"),
        "ids_signature": F.when(kind == 2, name), "ids_severity": F.when(kind == 2, severity), "action": F.when(act.rlike("block|deny|drop"), 2).when(act.rlike("reject"), 3).when(act.rlike("allow|accept|permit"), 1),
    }


# Process names and what they speak of; parsed no further.
PROCESSES = {"hostapd": 7, "wpa_supplicant": 7, "stahtd": 7, "charon": 8, "openvpn": 8, "wireguard": 8, "sshd": 3, "dropbear": 3, "sudo": 3, "dnsmasq": 5, "dhcpd": 4, "udhcpd": 4, "suricata": 2, "kernel": 6, "systemd": 6, "cron": 6, "crond": 6, "ntpd": 6}
FAMILIES = ((_cef, _cef_parts, _cef_fields), (_suricata, _suricata_parts, _suricata_fields), (_netfilter, _netfilter_parts, _netfilter_fields), (_dhcp, _dhcp_parts, _dhcp_fields), (_dns, _dns_parts, _dns_fields), (_ssh, _ssh_parts, _ssh_fields))
FIELDS = {
    "parser_name": "string", "event_type": "smallint", "src_ip": "string", "dst_ip": "string", "src_port": "int", "dst_port": "int", "protocol": "smallint", "action": "smallint", "in_iface": "string", "out_iface": "string", "rule_id": "string", "rule_name": "string",
    "username": "string", "device_id": "string", "ids_signature_id": "string", "ids_signature": "string", "ids_category": "string", "ids_severity": "smallint", "mac": "string", "client_name": "string", "query": "string", "query_type": "string", "method": "string",
}
# Fixed value: how some devices wrap the tag: twelve hex digits, model, firmware.
WRAPPED = r"^([0-9a-f]{12}),([^\s:]+):\s*(?:(\S+?)(?:\[(\d*)\])?:\s*)?(.*)$"


def parse(lines: DataFrame, zone: str = "UTC") -> DataFrame:
    """``lines`` (raw, received_at, and whatever else) with the event columns. Lines beyond 8 KiB are cut for parsing; raw stays whole."""
    text = F.regexp_replace(F.substring(F.col("raw"), 1, MAX_BYTES), r"[\x00\r\n]+$", "")
    pri = _rx(F.col("_t"), r"^<(\d{1,3})>", 1).cast("int")
    out = lines.withColumn("_t", text)
    ok = pri.isNotNull() & (pri <= 191)
    out = out.withColumns({"priority_present": F.coalesce(ok, F.lit(False)), "facility": F.when(ok, F.floor(pri / 8)).cast("smallint"), "severity": F.when(ok, pri % 8).cast("smallint"), "_rest": F.when(ok, F.regexp_replace("_t", r"^<\d{1,3}>", "")).otherwise(F.col("_t"))})
    out = _once(out, _five=_groups(F.col("_rest"), RFC5424, 7))
    rest = F.col("_rest")
    out = _once(out, _three=F.when(F.col("_five").isNull(), _groups(rest, RFC3164, 6)))
    new, old = F.col("_five").isNotNull(), F.col("_three").isNotNull()
    g5, g3 = lambda i: _nil(_group(F.col("_five"), i)), lambda i: _group(F.col("_three"), i)
    out = _once(out, _body=F.coalesce(F.nullif(_tail(F.col("_three"), 6), F.lit("")), F.when(~new, rest)))
    b = F.col("_body")
    out = _once(out, _tag=_groups(b, TAG, 3), _wrapped=_groups(b, WRAPPED, 5))
    tagged, wrap = F.col("_tag").isNotNull(), F.col("_wrapped").isNotNull()
    tag, inner = lambda i: _group(F.col("_tag"), i), lambda i: _group(F.col("_wrapped"), i)
    iso = F.unix_micros(F.try_to_timestamp(F.coalesce(g5(1), g3(4))))
    out = _once(
        out,
        syslog_version=F.when(new, 1).otherwise(0).cast("smallint"),
        hostname=F.coalesce(g5(2), g3(5)),
        app_name=F.coalesce(g5(3), F.when(wrap, F.regexp_extract(inner(3), r"([^/]*)$", 1)), F.when(tagged, F.regexp_extract(tag(1), r"([^/]*)$", 1))),
        proc_id=F.coalesce(g5(4), F.when(wrap, inner(4)), F.when(tagged, tag(2))),
        msg_id=g5(5),
        structured_data=structured_data(F.get("_five", F.lit(5))),
        event_time=F.coalesce(iso, F.when(old & g3(1).isNotNull(), bsd_time(g3(1), g3(2), g3(3), F.col("received_at"), zone))),
        message=F.when(new, F.regexp_replace(F.coalesce(_tail(F.col("_five"), 7), F.lit("")), "^\ufeff", "")).when(wrap, _tail(F.col("_wrapped"), 5)).when(tagged, _tail(F.col("_tag"), 3)).otherwise(b),
        wrapper_mac=F.when(wrap, inner(1)),
        wrapper_model=F.when(wrap, inner(2)),
    )
    message, app = F.col("message"), F.col("app_name")
    # The families see the message; a CEF line may sit behind anything, so it sees the whole rest.
    seen = [rest if claim is _cef else message for claim, _, _ in FAMILIES]
    which = F.lit(None).cast("int")
    for i in range(len(FAMILIES) - 1, -1, -1):
        which = F.when(FAMILIES[i][0](seen[i]), i).otherwise(which)
    out = _once(out, _family=which)
    out = _once(out, **{f"_p{i}": F.when(F.col("_family") == i, parts(seen[i])) for i, (_, parts, _) in enumerate(FAMILIES)})
    claims = [fields(F.col(f"_p{i}")) for i, (_, _, fields) in enumerate(FAMILIES)]
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in PROCESSES.items() for x in kv]), F.lower(app))
    values = {}
    for name, kind in FIELDS.items():
        value = F.lit(None).cast(kind)
        for i, fields in enumerate(claims):
            if name in fields:
                value = F.when(F.col("_family") == i, fields[name].cast(kind)).otherwise(value)
        values[name] = value
    values["event_type"] = F.coalesce(values["event_type"], known.cast("smallint"), F.lit(0).cast("smallint"))
    values["parse_status"] = F.when(F.col("_family").isNotNull(), PARSED).when(new | old | tagged, PARTIAL).otherwise(UNPARSED).cast("smallint")
    out = out.withColumns(values)
    return out.withColumn("time_inferred", F.col("event_time").isNull()).drop("_t", "_rest", "_five", "_three", "_body", "_tag", "_wrapped", "_family", *[f"_p{i}" for i in range(len(FAMILIES))])


def frames(data: bytes, most: int = 2 * MAX_BYTES) -> tuple[list[bytes], bytes]:
    """Messages of a TCP stream and what is left: octet-counted or ended by line feeds; an unbounded one is flushed."""
    out = []
    while data:
        head, _, tail = data.partition(b" ")
        if head.isdigit() and len(head) <= 5 and data[:1] != b"0":
            n = int(head)
            if len(tail) < n:
                break
            out.append(tail[:n].rstrip(b"\r\n"))
            data = tail[n:]
            continue
        line, feed, rest = data.partition(b"\n")
        if not feed:
            break
        if line.rstrip(b"\r"):
            out.append(line.rstrip(b"\r"))
        data = rest
    if len(data) > most:
        out.append(data)
        data = b""
    return out, data
