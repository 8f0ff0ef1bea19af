"""Other tables as packet streams.

Every adapter is one SQL projection, so that it says plainly which column comes from where.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import conform

#: Columns of a packet that an event gives, as SQL over ``event_id, us (microseconds), user_id, event_type, value``.
EVENT_COLUMNS = {
    "ord": "us * 1000 + event_id % 1000",
    "ts_us": "us",
    "src_ip": "CASE WHEN up THEN 'u' || CAST(user_id AS VARCHAR(20)) ELSE 's' || CAST(user_id % 7 AS VARCHAR(20)) END",
    "dst_ip": "CASE WHEN up THEN 's' || CAST(user_id % 7 AS VARCHAR(20)) ELSE 'u' || CAST(user_id AS VARCHAR(20)) END",
    "src_port": "CAST(CASE WHEN up THEN 40000 + user_id % 5 ELSE server_port END AS INT)",
    "dst_port": "CAST(CASE WHEN up THEN server_port ELSE 40000 + user_id % 5 END AS INT)",
    "protocol": "CAST(CASE WHEN user_id % 10 = 9 THEN 17 WHEN user_id % 10 = 8 THEN 1 ELSE 6 END AS INT)",
    "payload_len": "CAST(CASE WHEN size > 40 THEN size - 40 ELSE 0 END AS INT)",
    "total_len": "CAST(size AS INT)",
    "tcp_flags": "CAST(CASE event_type WHEN 'signup' THEN 2 WHEN 'view' THEN 16 WHEN 'click' THEN 24 WHEN 'purchase' THEN 17 WHEN 'error' THEN 4 ELSE 18 END AS INT)",
    "src_mac": "CASE WHEN event_id % 2 = 0 THEN 'aa:00:00:00:00:0' || CAST(user_id % 10 AS VARCHAR(20)) END",
    "dst_mac": "CASE event_id % 5 WHEN 0 THEN 'ff:ff:ff:ff:ff:ff' WHEN 1 THEN '01:00:5e:00:00:01' WHEN 2 THEN 'bb:00:00:00:00:0' || CAST(event_id % 3 AS VARCHAR(20)) ELSE NULL END",
    "vlan_id": "CAST(CASE WHEN event_id % 11 = 0 THEN event_id % 4 END AS INT)",
    "ip_ttl": "CAST(CASE WHEN up THEN 60 + event_id % 4 ELSE 120 + event_id % 3 END AS INT)",
    "ip_id": "CAST(event_id % 65536 AS INT)",
    "ip_tos": "CAST(event_id % 8 AS INT)",
    "ip_flags": "CAST(event_id % 3 AS INT)",
    "ip_version": "CAST(CASE WHEN user_id % 6 = 0 THEN 6 ELSE 4 END AS INT)",
    "ipv6_flow_label": "CAST(CASE WHEN user_id % 6 = 0 THEN event_id % 3 END AS INT)",
    "ipv6_traffic_class": "CAST(CASE WHEN user_id % 6 = 0 THEN event_id % 16 END AS INT)",
    "tcp_seq": "(event_id % 13) * 700",
    "tcp_ack": "CASE WHEN event_id % 3 > 0 THEN (event_id % 13) * 700 + size END",
    "tcp_window": "CAST((event_id * 37) % 65536 AS INT)",
    "tcp_mss": "CAST(CASE WHEN event_id % 4 = 0 THEN 1460 END AS INT)",
    "tcp_window_scale": "CAST(CASE WHEN event_id % 4 = 0 THEN event_id % 7 END AS INT)",
    "tcp_sack_permitted": "event_id % 9 = 0",
    "icmp_type": "CAST(CASE WHEN user_id % 10 = 8 THEN CASE WHEN up THEN 8 ELSE 0 END END AS INT)",
    "icmp_code": "CAST(CASE WHEN user_id % 10 = 8 THEN event_id % 2 END AS INT)",
    "icmp_id": "CAST(CASE WHEN user_id % 10 = 8 THEN user_id % 100 END AS INT)",
    "icmp_seq": "CAST(CASE WHEN user_id % 10 = 8 THEN event_id % 50 END AS INT)",
}

#: What the projection above is over: direction, server port and size of an event.
EVENT_BASE = """
SELECT event_id, {us} AS us, user_id, event_type, event_type IN ('signup', 'view', 'click') AS up,
    CASE user_id % 4 WHEN 0 THEN 443 WHEN 1 THEN 80 WHEN 2 THEN 53 ELSE 9001 END AS server_port,
    CAST(round(value * 100) AS BIGINT) AS size
FROM {events}
"""


def event_packets_sql(events: str, us: str) -> str:
    """The projection as SQL; ``us`` is the engine's expression for microseconds."""
    columns = ",\n    ".join(f"{sql} AS {name}" for name, sql in EVENT_COLUMNS.items())
    return f"SELECT {columns}\nFROM ({EVENT_BASE.format(us=us, events=events)}) base"


def events(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Packets of an event table: users talk to seven servers, and an event's type gives direction and flags."""
    sql = event_packets_sql("{events}", "unix_micros(CAST(ts AS TIMESTAMP))")
    return conform(spark.sql(sql, events=df))


def conversations(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Packets of a conversation table: a turn is a packet, from the user or the assistant, a second after the last one."""
    sql = """
    SELECT conv_id * 100000 + turn AS ord, turn * 1000000 AS ts_us,
        CASE WHEN up THEN 'user' ELSE 'assistant' END AS src_ip, CASE WHEN up THEN 'assistant' ELSE 'user' END AS dst_ip,
        CAST(CASE WHEN up THEN conv_id % 50000 ELSE 443 END AS INT) AS src_port, CAST(CASE WHEN up THEN 443 ELSE conv_id % 50000 END AS INT) AS dst_port,
        6 AS protocol, CAST(octet_length(text) AS INT) AS payload_len, CAST(octet_length(text) + 40 AS INT) AS total_len, 16 AS tcp_flags,
        CAST(text AS BINARY) AS raw_payload, CAST(conv_id AS STRING) AS file_id
    FROM (SELECT *, role <> 'assistant' AS up FROM {conversations})
    """
    return conform(spark.sql(sql, conversations=df))
