"""Direction, client identity as of a time, longest-prefix lookup, service names, identity resolution."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.netaddr import is_internal, packed_range, v4_range


def direction(src_internal: Column, dst_internal: Column) -> Column:
    """1 outbound, 2 inbound, 3 lan, 4 transit; 0 where an end is unknown."""
    return (
        F.when(src_internal.isNull() | dst_internal.isNull(), 0)
        .when(src_internal & dst_internal, 3)
        .when(src_internal, 1)
        .when(dst_internal, 2)
        .otherwise(4)
        .cast("smallint")
    )


def classify_direction(df: DataFrame, prefixes: list[str] | None = None) -> DataFrame:
    src, dst = is_internal(F.col("src_v4"), prefixes), is_internal(F.col("dst_v4"), prefixes)
    src, dst = F.when(F.col("src_v4").isNotNull(), src), F.when(F.col("dst_v4").isNotNull(), dst)
    return df.withColumns({"src_internal": src, "dst_internal": dst, "direction": direction(src, dst)})


def as_of(facts: DataFrame, history: DataFrame, key: str, at: str, *, value: str = "client_id", width: int = 30 * 86_400_000_000) -> DataFrame:
    """The value that holds at each fact's time: of the validities that hold then, the latest to begin, and of equal
    ones the greatest value. history: key, valid_from, valid_to (null while it holds on), value.

    The history is cut into time buckets of ``width`` and, within each, into stretches that have one value; facts
    then meet the one stretch of their key and bucket by an equi-join. A hot key is spread over its buckets, and no fact
    is matched with more than one row. Open validity ends at the last fact. Buckets multiply the rows of a small history, which
    the planner's estimate of its size does not see; both joins are therefore hinted, and nothing is broadcast.
    """
    last = facts.agg(F.max(at).alias("t")).first()["t"]
    if last is None:
        return facts.withColumn(value, F.lit(None).cast(dict(history.dtypes)[value]))
    to = F.least(F.coalesce("valid_to", F.lit(last + 1)), F.lit(last + 1))
    valid = history.where((F.col("valid_from") <= last) & (to > F.col("valid_from")) & F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col("valid_from").alias("_lo"), to.alias("_hi"), F.col(value).alias("_value"))
    slot = lambda t: F.expr(f"floor({t} / {width})")
    laid = valid.withColumn("_b", F.explode(F.sequence(slot("_lo"), slot("(_hi - 1)"))))
    clipped = laid.withColumns({"_from": F.greatest("_lo", F.col("_b") * width), "_to": F.least("_hi", (F.col("_b") + 1) * width)})
    edges = clipped.select("_k", "_b", F.explode(F.array("_from", "_to")).alias("_at")).distinct()
    cuts = edges.withColumn("_end", F.lead("_at").over(Window.partitionBy("_k", "_b").orderBy("_at"))).where(F.col("_end").isNotNull())
    held = cuts.join(clipped.hint("merge"), ["_k", "_b"]).where((F.col("_from") <= F.col("_at")) & (F.col("_to") >= F.col("_end")))
    stretches = held.groupBy("_k", "_b", "_at", "_end").agg(F.max(F.struct("_lo", "_value")).alias("_v")).select("_k", F.col("_b").alias("_bucket"), "_at", "_end", F.col("_v._value").alias("_value"))
    on = (F.col(key) == F.col("_k")) & (slot(at) == F.col("_bucket")) & (F.col("_at") <= F.col(at)) & (F.col(at) < F.col("_end"))
    return facts.join(stretches.hint("merge"), on, "left").withColumn(value, F.col("_value")).drop("_k", "_bucket", "_at", "_end", "_value")


def prefix_table(spark, prefixes: list[tuple]) -> DataFrame:
    """(prefix, country, asn, org) as (lo, hi, bits, country, asn, org) with numeric IPv4 bounds."""
    rows = [(*v4_range(p), ipaddress.ip_network(p, strict=False).prefixlen, c, a, o) for p, c, a, o in prefixes if ipaddress.ip_network(p, strict=False).version == 4]
    return spark.createDataFrame(rows, "lo bigint, hi bigint, bits int, country string, asn bigint, org string")


def flatten_prefixes(prefixes: list[tuple]) -> list[tuple]:
    """Disjoint ranges (lo, hi, country, asn, org) in which the longest prefix has already won."""
    edges: set[int] = set()
    spans = []
    for p, c, a, o in prefixes:
        net = ipaddress.ip_network(p, strict=False)
        if net.version == 4:
            lo, hi = v4_range(p)
            spans.append((net.prefixlen, lo, hi, c, a, o))
            edges |= {lo, hi + 1}
    cuts, out = sorted(edges), []
    for lo, end in zip(cuts, cuts[1:], strict=False):
        best = max((s for s in spans if s[1] <= lo and end - 1 <= s[2]), default=None, key=lambda s: s[0])
        if best:
            if out and out[-1][1] == lo - 1 and out[-1][2:] == best[3:]:
                out[-1] = (out[-1][0], end - 1, *best[3:])
            else:
                out.append((lo, end - 1, *best[3:]))
    return out


def longest_prefix(df: DataFrame, address: str, table: DataFrame) -> DataFrame:
    """country, asn and org of the longest prefix that holds a numeric IPv4 address.

    An equi-join for each prefix length in use: the address is masked to the length and looked up. Every join is
    a hash join on a narrow key, whatever the size of the table; no range join is planned.
    """
    lengths = sorted((r["bits"] for r in table.select("bits").distinct().collect()), reverse=True)  # 33 at most
    found = F.lit(None).cast("struct<country:string,asn:bigint,org:string>")
    out = df
    for n in lengths:
        part = table.where(F.col("bits") == n).groupBy(F.col("lo").alias(f"_lo{n}")).agg(F.min(F.struct("country", "asn", "org")).alias(f"_hit{n}"))
        size = 1 << (32 - n)
        out = out.withColumn(f"_key{n}", F.col(address) - F.pmod(F.col(address), F.lit(size))).join(part, F.col(f"_key{n}") == F.col(f"_lo{n}"), "left")
        found = F.coalesce(found, F.col(f"_hit{n}"))
    out = out.withColumn("_geo", found)
    drop = [f"{p}{n}" for n in lengths for p in ("_lo", "_key", "_hit")]
    return out.withColumns({"country": F.col("_geo.country"), "asn": F.col("_geo.asn"), "org": F.col("_geo.org")}).drop("_geo", *drop)


def longest_prefix_v6(df: DataFrame, packed: str, prefixes: list[tuple]) -> DataFrame:
    """The same over sixteen-byte addresses for a short literal list, nested as one expression: longest first."""
    out = F.lit(None).cast("struct<country:string,asn:bigint,org:string>")
    for p, c, a, o in sorted(prefixes, key=lambda r: ipaddress.ip_network(r[0], strict=False).prefixlen):
        lo, hi = packed_range(p)
        value = F.struct(F.lit(c).cast("string").alias("country"), F.lit(a).cast("bigint").alias("asn"), F.lit(o).cast("string").alias("org"))
        out = F.when((F.col(packed) >= F.lit(bytearray(lo))) & (F.col(packed) <= F.lit(bytearray(hi))), value).otherwise(out)
    return df.withColumn("geo", out)


def exporters(datagrams: DataFrame) -> DataFrame:
    """Exporter dimension by natural key, with stable hashed ids and what was seen of each."""
    key = F.concat_ws("|", "address", "domain", "kind")
    out = datagrams.groupBy("address", "domain", "kind").agg(F.count(F.lit(1)).alias("messages"), F.min("received_at").alias("first_seen"), F.max("received_at").alias("last_seen"))
    return out.withColumn("exporter_id", F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint"))


def clients_view(clients: DataFrame, addresses: DataFrame, client_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """Clients with their current addresses and tags, latest seen first."""
    now = addresses.where(F.col("valid_to").isNull()).groupBy("client_id").agg(F.array_join(F.array_sort(F.collect_set("address")), ",").alias("addresses"))
    named = client_tags.join(tags, "tag_id").groupBy("client_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("tags"))
    return clients.join(now, "client_id", "left").join(named, "client_id", "left").orderBy(F.desc("last_seen"), "client_id")


# Identity resolution ------------------------------------------------------------------------------------

HYSTERESIS = 3
IDENTITY_SCHEMA = "ip string, mac string, client_key string, valid_from bigint, valid_to bigint, hostname string"


def resolve_identities(observations: DataFrame, sightings: int = HYSTERESIS) -> DataFrame:
    """Validity intervals of (ip -> client) from observations (ip, mac, hostname, at, source).

    A client is named by the MAC, or by the address while no MAC was ever seen. A new MAC on an address moves
    it at once when DHCP says so, else at the ``sightings``-th sighting in a row. The fold is by address: an
    address's observations, in order, are reduced in the JVM to the moves, and the moves to intervals.
    """
    seq = F.array_sort(F.collect_list(F.struct("at", F.coalesce("mac", F.lit("")).alias("mac"), (F.col("source") == "dhcp").alias("dhcp"))))
    state = "struct<cur:string,cand:string,n:int,moves:array<struct<at:bigint,mac:string>>>"
    start = F.lit(None).cast(state)
    empty = F.expr("named_struct('cur', '', 'cand', '', 'n', 0, 'moves', cast(array() as array<struct<at:bigint,mac:string>>))").cast(state)

    def step(s, o):
        s = F.coalesce(s, empty)
        move = lambda m: F.concat(s["moves"], F.array(F.struct(o["at"].alias("at"), m.alias("mac"))))
        pack = lambda cur, cand, n, moves: F.struct(cur.alias("cur"), cand.alias("cand"), n.cast("int").alias("n"), moves.alias("moves")).cast(state)
        same = (o["mac"] == "") | (o["mac"] == s["cur"])
        run = F.when(o["mac"] == s["cand"], s["n"] + 1).otherwise(1)
        first = F.size(s["moves"]) == 0
        learn = (s["cur"] == "") & (o["mac"] != "")
        return (
            F.when(first | learn | (~same & (o["dhcp"] | (run >= sightings))), pack(o["mac"], F.lit(""), F.lit(0), move(o["mac"])))
            .when(same, pack(s["cur"], F.lit(""), F.lit(0), s["moves"]))
            .otherwise(pack(s["cur"], o["mac"], run, s["moves"]))
        )

    folded = observations.groupBy("ip").agg(F.aggregate(seq, start, step)["moves"].alias("moves"), F.max_by("hostname", F.when(F.col("hostname").isNotNull(), F.col("at"))).alias("hostname"))
    rows = folded.select("ip", "hostname", "moves", F.posexplode("moves").alias("i", "move"))
    until = F.get("moves", F.col("i") + 1)["at"]
    out = rows.select("ip", F.when(F.col("move.mac") != "", F.col("move.mac")).alias("mac"), F.when(F.col("move.mac") != "", F.col("move.mac")).otherwise(F.concat(F.lit("ip:"), "ip")).alias("client_key"), F.col("move.at").alias("valid_from"), until.alias("valid_to"), "hostname")
    return out


def dhcp_observations(events: DataFrame) -> DataFrame:
    """Observations out of DHCP acknowledgements."""
    ack = events.where((F.col("event_type") == 4) & F.contains(F.col("message"), F.lit("DHCPACK")))
    return ack.select(F.col("src_ip").alias("ip"), F.get_json_object("attrs", "$['dhcp.mac']").alias("mac"), F.get_json_object("attrs", "$['dhcp.host']").alias("hostname"), F.coalesce("event_time", "received_at").alias("at"), F.lit("dhcp").alias("source"))


def merge_clients(history: DataFrame, keep, gone) -> DataFrame:
    """All of one client's validity goes to another."""
    return history.withColumn("client_id", F.when(F.col("client_id") == gone, F.lit(keep)).otherwise(F.col("client_id")))


def split_client(history: DataFrame, address: str, at: int, new_id) -> DataFrame:
    """From a time on, an address belongs to a new client."""
    hit = (F.col("address") == address) & (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))
    closed = history.withColumn("valid_to", F.when(hit, F.lit(at)).otherwise(F.col("valid_to")))
    opened = history.where(hit).withColumns({"client_id": F.lit(new_id).cast(dict(history.dtypes)["client_id"]), "valid_from": F.lit(at).cast("bigint")})
    return closed.unionByName(opened)


def last_seen(clients: DataFrame, sightings: DataFrame) -> DataFrame:
    """Clients with last_seen moved forward to the newest sighting (client_id, at); never back."""
    seen = sightings.groupBy("client_id").agg(F.max("at").alias("_at"))
    return clients.join(seen, "client_id", "left").withColumn("last_seen", F.greatest("last_seen", "_at")).drop("_at")
