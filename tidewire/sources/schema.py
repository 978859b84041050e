"""The two fact schemas and the tables around them."""

from __future__ import annotations

from pyspark.sql import types as T

FLOW_DDL = """
flow_id bigint, origin smallint, exporter_id bigint, exporter_addr string, observation_domain_id bigint, export_seq bigint,
received_at bigint, export_time bigint, start_time bigint, end_time bigint, clock_skew_us bigint, ip_version smallint,
src_ip string, dst_ip string, src_v4 bigint, dst_v4 bigint, src_port int, dst_port int, protocol smallint, tcp_flags int,
icmp_type smallint, icmp_code smallint, packets bigint, octets bigint, rev_packets bigint, rev_octets bigint, ingress_if bigint,
egress_if bigint, src_vlan int, dst_vlan int, flow_direction smallint, flow_end_reason smallint, sampling_interval bigint,
post_nat_src_ip string, post_nat_dst_ip string, post_nat_src_port int, post_nat_dst_port int, app_id string, ie_extra string,
direction smallint, src_internal boolean, dst_internal boolean, src_client_id bigint, dst_client_id bigint, src_country string,
dst_country string, src_asn bigint, dst_asn bigint, dst_org string, service string, flow_count bigint, enrichment_version int,
schema_version int
"""
EVENT_DDL = """
event_id bigint, origin smallint, received_at bigint, event_time bigint, time_inferred boolean, source_ip string, transport smallint,
syslog_version smallint, facility smallint, severity smallint, priority_present boolean, hostname string, app_name string,
proc_id string, msg_id string, structured_data string, message string, raw string, raw_bytes binary, parser_name string,
parser_version int, parse_status smallint, event_type smallint, src_ip string, dst_ip string, src_v4 bigint, dst_v4 bigint,
src_port int, dst_port int, protocol smallint, action smallint, in_iface string, out_iface string, vlan int, rule_id string,
rule_name string, username string, device_id string, ids_signature_id string, ids_signature string, ids_category string,
ids_severity smallint, src_client_id bigint, dst_client_id bigint, direction smallint, src_internal boolean, dst_internal boolean,
dst_country string, dst_asn bigint, attrs string, enrichment_version int, schema_version int
"""


_TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "smallint": T.ShortType(), "string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType()}


def _struct(ddl: str) -> T.StructType:
    """A flat schema from its text, without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in ddl.split(","))])


FLOW_SCHEMA = _struct(FLOW_DDL)
EVENT_SCHEMA = _struct(EVENT_DDL)
DATAGRAM_SCHEMA = _struct("received_at bigint, kind string, transport smallint, source string, source_port int, local_port int, payload binary")
