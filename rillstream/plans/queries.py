"""Registered queries over the driver's tables: the engine's operators on event, trade and text streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import columns as C
from ..functions.parsers import entropy_facts
from ..operators.graph import betweenness, clustering, communities, connection_features, temporal
from ..operators.labels import label_counts, label_sessions, lookup
from ..operators.sessionize import sessionize
from ..operators.sinks import flat, messages
from ..sources import adapters
from .extract import extract
from .oracle import FEATURES

TIMEOUT = 21600.0
KEYS = ("ip_a", "port_a", "ip_b", "port_b", "protocol", "session_no")
GROUP_OF = {
    "flow_sessions": "flow_meta",
    "flow_meta_rates": "flow_meta",
    "timing_iat_all": "timing",
    "timing_iat_dir": "timing",
    "timing_bursts": "timing",
    "size_stats": "size",
    "size_l7": "size",
    "size_dominant": "size",
    "tcp_flag_counts": "tcp",
    "tcp_state": "tcp",
    "padding_scores": "padding",
    "fingerprint_vpn_tor": "fingerprint",
    "window_changes": "tcp_window",
    "tcp_option_facts": "tcp_options",
    "dup_ack": "tcp_sequence",
    "ip_facts": "ip_extended",
    "ipv6_facts": "ipv6_options",
    "icmp_facts": "icmp",
    "mac_facts": "mac",
    "syn_fingerprint": "tcp_fingerprint",
    "hash_anonymise": "flow_meta",
    "port_class": "flow_meta",
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.events(spark, read(spark, sf_dir, "events"))


def shown(kind: str, name: str):
    c = F.col(name)
    if kind == "i":
        c = c.cast("long")
    elif kind[0] == "u":
        c = F.round(c * 1e6, int(kind[1:]))
    elif kind[0] == "f":
        c = F.round(c.cast("double"), int(kind[1:]))
    return c.alias(name)


def key_columns():
    return [F.col(f"_{k}").cast("string" if k.startswith("ip") else "long").alias(k) for k in KEYS]


def session_features(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """The listed features of one group, for every session of the event stream."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        hide = {"anonymize_ips": True, "anonymization_salt": "pepper", "include_flow_id": True} if name == "hash_anonymise" else {}
        cfg = Config(flow_timeout=TIMEOUT, groups=(GROUP_OF[name],), **hide)
        wide = extract(packets(spark, sf_dir), cfg, keep_keys=True)
        mine = [shown(kind, feature) for feature, kind, _ in FEATURES[name]]
        return wide.select(*key_columns(), *mine)

    query.__name__ = name
    return query


def splt_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = extract(packets(spark, sf_dir), Config(flow_timeout=TIMEOUT, groups=("timing",), include_splt=True), keep_keys=True)
    each = wide.select(*key_columns(), F.posexplode("splt"))
    return each.select(*KEYS, (F.col("pos") + 1).cast("long").alias("pos"), F.col("col.len").cast("long").alias("len"), F.round(F.col("col.iat") * 1e6).cast("long").alias("iat_us"), F.col("col.dir").cast("long").alias("dir"))


def protocol_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir)
    whole = p.agg(F.count("*").alias("all"))  # one row
    by = p.groupBy(F.col("protocol").cast("long").alias("protocol")).agg(F.count("*").alias("packets"), F.sum("total_len").alias("bytes"))
    return by.join(F.broadcast(whole)).select("protocol", "packets", "bytes", F.round(F.col("packets") / F.col("all"), 6).alias("share"))


def rtt_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = extract(packets(spark, sf_dir), Config(flow_timeout=TIMEOUT, groups=("tcp_rtt",)), keep_keys=True)
    return wide.select(*key_columns(), *(shown(k, f"tcp_rtt_ack_{n}") for n, k in (("min", "u0"), ("max", "u0"), ("mean", "f3"))))


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as sessions between nations: ``file_id, src, dst, service, packets, bytes, start_us, end_us``."""
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    nation = read(spark, sf_dir, "nation")
    both = lines.join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    both = both.join(nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("src")), "c_nationkey").join(nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("dst")), "s_nationkey")
    us = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    return both.select(F.lit("").alias("file_id"), "src", "dst", (F.lit(1024) + F.col("l_linenumber")).alias("service"), F.lit(1).cast("long").alias("packets"), F.round("l_extendedprice").cast("long").alias("bytes"), us.alias("start_us"), us.alias("end_us"))


def conn_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trade(spark, sf_dir)
    flows = t.select("file_id", F.col("src").alias("src_node_ip"), F.lit(0).alias("src_node_port"), F.col("dst").alias("dst_node_ip"), F.col("service").alias("dst_node_port"), "packets", "bytes", "start_us", "end_us")
    wide = connection_features(flows, Config(), metrics=False)
    names = ["conn_src_dst_flows", "conn_src_unique_dsts", "conn_dst_unique_srcs", "conn_src_total_flows", "conn_dst_total_flows", "conn_src_total_bytes", "conn_dst_total_bytes", "conn_src_unique_ports"]
    return wide.select(F.col("src_node_ip").alias("src"), F.col("dst_node_ip").alias("dst"), *(F.col(n).cast("long").alias(n) for n in names)).distinct()


def follow_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of orders that follow one another by key: ``file_id, src, dst``."""
    orders = read(spark, sf_dir, "orders")
    here = orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").cast("string").alias("src"))
    after = orders.select((F.col("o_orderkey") - 1).alias("k"), F.col("o_custkey").cast("string").alias("dst"))
    return here.join(after, "k").select(F.lit("").alias("file_id"), "src", "dst").distinct()


def conn_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering(follow_ups(spark, sf_dir)).select("node", F.round("clustering", 6).alias("clustering"))


def conn_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal(trade(spark, sf_dir)).select("node", F.round("rate", 9).alias("rate"), F.round("spread", 0).alias("spread"), F.col("burst").cast("long").alias("burst"))


def label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    return lookup(read(spark, sf_dir, "documents").select("doc_id"), labels, ["doc_id"], order="label")


def label_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_counts(read(spark, sf_dir, "labels").select(F.col("quality").cast("string").alias("label")))


def entropy_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = entropy_facts(F.col("text").cast("binary"))
    each = read(spark, sf_dir, "benchmark").select("item_id", facts.alias("f"))
    return each.select("item_id", F.col("f.n").cast("long").alias("n"), F.round("f.entropy", 6).alias("entropy"), F.col("f.printable").cast("long").alias("printable"), F.col("f.high").cast("long").alias("high"))


def ja3_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    of = lambda n, make: F.transform(F.sequence(F.lit(1), F.lit(n)), make)
    groups = F.when(p % 4 > 0, F.transform(F.sequence(F.lit(0).cast("long"), p % 4 - 1), lambda k: k + 23)).otherwise(F.array().cast("array<bigint>"))
    text = C.ja3_string(p % 3 + 769, of(5, lambda k: p * k % 50 + 4865), of(4, lambda k: p * k * 2570 % 65536), groups, F.array(F.lit(0)))
    return read(spark, sf_dir, "pages").select("page_id", text.alias("ja3"), F.md5(text.cast("binary")).alias("ja3_hash"))


def profile_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A projection that names its features, by their full ids and by name."""
    cfg = Config(flow_timeout=TIMEOUT, groups=("flow_meta", "size"), features=("size.dominant_pkt_size", "dominant_pkt_ratio"))
    wide = extract(packets(spark, sf_dir), cfg, keep_keys=True)
    return wide.select(*key_columns(), shown("i", "dominant_pkt_size"), shown("f6", "dominant_pkt_ratio"))


def bidir_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = Config(flow_timeout=TIMEOUT, groups=("flow_meta",), bidirectional_split=True)
    wide = extract(packets(spark, sf_dir), cfg, keep_keys=True)
    return wide.select(*key_columns(), shown("i", "total_total_bytes"), shown("i", "bytes_fwd"))


def conversation_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = adapters.conversations(spark, read(spark, sf_dir, "conversations"))
    cfg = Config(flow_timeout=1e9, terminate_on_fin_rst=False, groups=("flow_meta", "size"))
    wide = extract(p, cfg, keep_keys=True)
    return wide.select(F.col("_file_id").alias("file_id"), shown("i", "total_packets"), shown("i", "total_bytes"), shown("f3", "payload_len_std"))


def closed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessionised stream itself, for callers that bring their own aggregates."""
    return sessionize(packets(spark, sf_dir), Config(flow_timeout=TIMEOUT))


def conn_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return betweenness(follow_ups(spark, sf_dir)).select("node", F.round("betweenness", 9).alias("betweenness"))


def conn_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities(follow_ups(spark, sf_dir)).select("node", F.col("community").cast("long").alias("community"))


def seq_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps and late packets, folded over each direction's sequence numbers."""
    wide = extract(packets(spark, sf_dir), Config(flow_timeout=TIMEOUT, groups=("tcp_sequence",)), keep_keys=True)
    return wide.select(*key_columns(), *(shown("i", f"tcp_seq_{d}_{n}") for d in ("fwd", "bwd") for n in ("gaps", "ooo")))


def entropy_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy and byte classes of the first bytes that each side of a conversation says."""
    p = adapters.conversations(spark, read(spark, sf_dir, "conversations"))
    wide = extract(p, Config(flow_timeout=1e9, terminate_on_fin_rst=False, groups=("entropy",)), keep_keys=True)
    names = ("entropy_payload", "entropy_initiator", "entropy_responder", "printable_ratio", "high_byte_ratio", "byte_distribution_uniformity")
    return wide.select(F.col("_file_id").alias("file_id"), *(shown("f6", n) for n in names), shown("i", "payload_bytes_sampled"))


def sink_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a topic would get: a session's key, and its features as JSON."""
    wide = extract(packets(spark, sf_dir), Config(flow_timeout=TIMEOUT, groups=("flow_meta", "timing"), include_splt=True))
    return messages(flat(wide), "src_ip")


def label_sessions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions labelled by their endpoints, in either direction, from labels of the users of one service."""
    wide = extract(packets(spark, sf_dir), Config(flow_timeout=TIMEOUT, groups=("flow_meta",)))
    users = packets(spark, sf_dir).where("src_ip LIKE 'u%' AND dst_port = 443").select("src_ip", "dst_ip").distinct()
    return label_sessions(wide, users.withColumn("label", F.concat(F.lit("of "), F.col("src_ip")))).groupBy("label").agg(F.count("*").alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: session_features(name) for name in FEATURES} | {
    "splt_exploded": splt_exploded,
    "protocol_histogram": protocol_histogram,
    "rtt_asof": rtt_asof,
    "conn_basic": conn_basic,
    "conn_clustering": conn_clustering,
    "conn_temporal": conn_temporal,
    "label_join": label_join,
    "label_counts": label_counts_query,
    "entropy_text": entropy_text,
    "ja3_strings": ja3_strings,
    "profile_projection": profile_projection,
    "bidir_split": bidir_split,
    "conversation_directions": conversation_directions,
    "conn_betweenness": conn_betweenness,
    "conn_communities": conn_communities,
    "seq_fold": seq_fold,
    "entropy_flows": entropy_flows,
    "sink_json_rows": sink_json_rows,
    "label_sessions": label_sessions_query,
}
