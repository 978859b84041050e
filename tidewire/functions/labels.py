"""Codes of the stored enums, and their labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stored codes.
DIRECTION = {0: "unknown", 1: "outbound", 2: "inbound", 3: "lan", 4: "transit"}
ACTION = {0: "unknown", 1: "allow", 2: "deny", 3: "reject", 4: "nat", 5: "alert"}
EVENT_TYPE = {0: "unknown", 1: "firewall", 2: "ids", 3: "auth", 4: "dhcp", 5: "dns", 6: "system", 7: "wireless", 8: "vpn", 9: "other"}
SEVERITY = {0: "emergency", 1: "alert", 2: "critical", 3: "error", 4: "warning", 5: "notice", 6: "info", 7: "debug"}
PROTOCOL = {1: "icmp", 2: "igmp", 6: "tcp", 17: "udp", 47: "gre", 50: "esp", 51: "ah", 58: "icmpv6", 132: "sctp"}
# Fixed values: (port, protocol) -> service.
SERVICES = {
    (20, 6): "ftp-data", (21, 6): "ftp", (22, 6): "ssh", (23, 6): "telnet", (25, 6): "smtp", (53, 17): "dns", (53, 6): "dns", (67, 17): "dhcp",
    (68, 17): "dhcp", (69, 17): "tftp", (80, 6): "http", (110, 6): "pop3", (123, 17): "ntp", (137, 17): "netbios-ns", (138, 17): "netbios-dgm",
    (139, 6): "netbios-ssn", (143, 6): "imap", (161, 17): "snmp", (162, 17): "snmptrap", (179, 6): "bgp", (389, 6): "ldap", (443, 6): "https",
    (443, 17): "quic", (445, 6): "smb", (465, 6): "smtps", (500, 17): "isakmp", (514, 17): "syslog", (515, 6): "printer", (587, 6): "submission",
    (631, 6): "ipp", (636, 6): "ldaps", (853, 6): "dns-over-tls", (873, 6): "rsync", (989, 6): "ftps-data", (990, 6): "ftps", (993, 6): "imaps", (995, 6): "pop3s",
}


def label(code: Column, names: dict[int, str], default: str | None = None) -> Column:
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), code.cast("int"))
    return found if default is None else F.coalesce(found, F.lit(default))


def _service(port: Column, proto: Column) -> Column:
    names = F.create_map(*[F.lit(x) for (p, pr), name in SERVICES.items() for x in (p * 256 + pr, name)])
    key = lambda pr: F.try_element_at(names, (port * 256 + pr).cast("int"))
    other = F.when(proto == 6, 17).when(proto == 17, 6)
    return F.coalesce(key(proto), key(other))


def service_name(src_port: Column, dst_port: Column, proto: Column) -> Column:
    """The destination port's service, else the source port's; either with TCP and UDP standing in for one another."""
    return F.coalesce(_service(dst_port, proto), _service(src_port, proto))


def human_bytes(n: Column) -> Column:
    out = F.when(n < 1000, F.concat(n.cast("string"), F.lit(" B")))
    for power, unit in ((2, "kB"), (3, "MB"), (4, "GB"), (5, "TB")):
        out = out.when(n < 1000**power, F.concat(F.format_number(n / float(1000 ** (power - 1)), 1), F.lit(f" {unit}")))
    return out.otherwise(F.concat(F.format_number(n / 1e15, 1), F.lit(" PB")))
