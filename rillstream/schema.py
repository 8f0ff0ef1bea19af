"""The packet row, the unit of every source."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACKET_DDL = """
file_id STRING, ord BIGINT, ts_us BIGINT,
src_ip STRING, dst_ip STRING, src_port INT, dst_port INT, protocol INT,
payload_len INT, total_len INT, tcp_flags INT, raw_payload BINARY,
src_mac STRING, dst_mac STRING, eth_type INT, vlan_id INT,
ip_ttl INT, ip_id INT, ip_tos INT, ip_flags INT, ip_version INT,
ipv6_flow_label INT, ipv6_traffic_class INT,
tcp_seq BIGINT, tcp_ack BIGINT, tcp_window INT,
tcp_options_raw BINARY, tcp_mss INT, tcp_window_scale INT,
tcp_timestamp STRUCT<tsval:BIGINT,tsecr:BIGINT>,
tcp_sack_permitted BOOLEAN, tcp_sack_blocks ARRAY<STRUCT<l:BIGINT,r:BIGINT>>,
icmp_type INT, icmp_code INT, icmp_id INT, icmp_seq INT
"""



@lru_cache(1)
def packet_type() -> T.StructType:
    """The row's type; parsing it needs a session."""
    return T.StructType.fromDDL(PACKET_DDL)


def packet_names() -> list[str]:
    """Names of the packet columns, in order."""
    return [line.split()[0] for line in re.split(r",\s+(?=\w+ [A-Z])", PACKET_DDL.strip())]


REQUIRED = ("ord", "ts_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "payload_len", "total_len")

FIN, SYN, RST, PSH, ACK, URG, ECE, CWR = 1, 2, 4, 8, 16, 32, 64, 128


def flag(mask: int, of: str = "tcp_flags") -> Column:
    """Whether any bit of the mask is set; false without flags."""
    return F.coalesce(F.col(of).bitwiseAND(F.lit(mask)) != 0, F.lit(False))


def conform(df: DataFrame) -> DataFrame:
    """``df`` with every packet column, in order and type; absent optional ones are null, others stay behind them."""
    if missing := [c for c in REQUIRED if c not in df.columns]:
        raise ValueError(f"not a packet table, without {missing}")
    own = [(F.col(f.name) if f.name in df.columns else F.lit("") if f.name == "file_id" else F.lit(None)).cast(f.dataType).alias(f.name) for f in packet_type().fields]
    return df.select(*own, *(c for c in df.columns if c not in packet_type().names))
