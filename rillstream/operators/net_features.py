"""Feature groups of packet headers: TCP state, options, windows, sequences and round trips, IP, ICMP and link layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.columns import bits, count, ever, first, kinds, last, only, or_zero, ratio, real
from ..schema import ACK, CWR, ECE, FIN, PSH, RST, SYN, URG, flag
from .base import Columns, Group
from .flow_features import bwd, fwd, in_order
from .sessionize import SESSION

WRAP = 1 << 32
SIDES = (("fwd", True), ("bwd", False))


def side(forward: bool) -> Column:
    return fwd() if forward else bwd()


def as_int(cond: Column) -> Column:
    return cond.cast("int")


# tcp ------------------------------------------------------------------------


def tcp_aggregate(cfg: Config) -> Columns:
    known = F.col("tcp_flags").isNotNull()
    f = lambda m: flag(m)
    both = lambda m: F.coalesce(F.col("tcp_flags").bitwiseAND(F.lit(m)) == m, F.lit(False))
    odd = known & ((F.col("tcp_flags") == 0) | both(FIN | PSH | URG) | (f(FIN) & ~f(ACK) & ~f(SYN)) | both(SYN | FIN) | both(SYN | RST))
    out: Columns = {f"c_{name}": count(f(mask)) for name, mask in (("fin", FIN), ("rst", RST), ("ack", ACK), ("psh", PSH), ("urg", URG), ("ece", ECE), ("cwr", CWR))}
    out |= {
        "c_n": F.count(F.lit(1)),
        "c_syn": count(f(SYN) & ~f(ACK)),
        "c_synack": count(f(SYN) & f(ACK)),
        "c_init_syn": ever(f(SYN) & ~f(ACK) & fwd()),
        "c_resp_synack": ever(f(SYN) & f(ACK) & bwd()),
        "c_fin_f": ever(f(FIN) & fwd()),
        "c_fin_b": ever(f(FIN) & bwd()),
        "c_data": count(known & (F.col("payload_len") > 0)),
        "c_bare": count(f(ACK) & (F.col("payload_len") == 0) & ~f(SYN | FIN | RST)),
        "c_odd": ever(odd),
        "c_or": or_zero(F.bit_or("tcp_flags")),
        "c_or_f": or_zero(F.bit_or(only("tcp_flags", fwd()))),
        "c_or_b": or_zero(F.bit_or(only("tcp_flags", bwd()))),
    }
    return out


def tcp_finish(cfg: Config) -> Columns:
    c = F.col
    tcp = c("protocol") == 6
    some = lambda v: F.when(tcp, v).otherwise(F.lit(0))
    is_ = lambda v: tcp & v
    share = lambda v: F.when(tcp, v / c("c_n")).otherwise(F.lit(0.0))
    out: Columns = {"tcp_is_tcp": tcp, "tcp_syn_count": some(c("c_syn")), "tcp_synack_count": some(c("c_synack"))}
    out |= {f"tcp_{k}_count": some(c(f"c_{k}")) for k in ("fin", "rst", "ack", "psh", "urg", "ece", "cwr")}
    status = bits(
        (c("c_init_syn"), 1), (c("c_resp_synack"), 2), (c("c_ack") > c("c_synack"), 4), (c("c_fin_f"), 8), (c("c_fin_b"), 16), (c("c_rst") > 0, 32), (c("c_data") > 0, 64), (c("c_odd"), 128)
    )
    return out | {
        "tcp_complete_handshake": is_(c("c_init_syn") & c("c_resp_synack")),
        "tcp_graceful_close": is_(c("c_fin_f") & c("c_fin_b")),
        "tcp_reset_close": is_(c("c_rst") > 0),
        "tcp_syn_ratio": share(c("c_syn") + c("c_synack")),
        "tcp_fin_ratio": share(c("c_fin")),
        "tcp_rst_ratio": share(c("c_rst")),
        "tcp_psh_ratio": share(c("c_psh")),
        "tcp_data_packets": some(c("c_data")),
        "tcp_ack_only_packets": some(c("c_bare")),
        "tcp_flags_anomaly": is_(c("c_odd")),
        "tcp_initiator_syn": is_(c("c_init_syn")),
        "tcp_responder_synack": is_(c("c_resp_synack")),
        "tcp_fstat": some(status),
        "tcp_flags_agg": some(c("c_or")),
        "tcp_flags_fwd": some(c("c_or_f")),
        "tcp_flags_bwd": some(c("c_or_b")),
    }


# mac, ip, ipv6, icmp ----------------------------------------------------------


def mac_aggregate(cfg: Config) -> Columns:
    dst = F.col("dst_mac")
    broadcast = F.lower(dst) == "ff:ff:ff:ff:ff:ff"
    octet = F.try_to_number(F.conv(F.split_part(dst, F.lit(":"), F.lit(1)), 16, 10), F.lit("999")).cast("int")
    named = lambda c: F.when(F.col(c) != "", F.col(c))
    return {
        "l_src": first("src_mac"),
        "l_dst": first("dst_mac"),
        "l_type": first("eth_type"),
        "l_vlan": F.min("vlan_id"),
        "l_vlans": kinds("vlan_id"),
        "l_srcs": kinds(named("src_mac")),
        "l_dsts": kinds(named("dst_mac")),
        "l_broad": count(broadcast),
        "l_multi": count(~broadcast & (octet.bitwiseAND(F.lit(1)) == 1)),
    }


def mac_finish(cfg: Config) -> Columns:
    c = F.col
    has = lambda n: F.coalesce(c(n) != "", F.lit(False))
    return {
        "mac_src": F.coalesce("l_src", F.lit("")),
        "mac_dst": F.coalesce("l_dst", F.lit("")),
        "mac_eth_type": or_zero(c("l_type")),
        "mac_vlan_id": or_zero(c("l_vlan")),
        "mac_vlan_count": c("l_vlans"),
        "mac_unique_src_count": c("l_srcs"),
        "mac_unique_dst_count": c("l_dsts"),
        "mac_stat": bits((has("l_src"), 1), (has("l_dst"), 2), (c("l_srcs") > 1, 4), (c("l_dsts") > 1, 8), (c("l_vlans") > 0, 16)),
        "mac_broadcast_count": c("l_broad"),
        "mac_multicast_count": c("l_multi"),
    }


def ip_prepare(df: DataFrame, cfg: Config) -> DataFrame:
    """The step from the last known IP id, modulo 2**16."""
    known = F.last("ip_id", ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, -1))
    step = F.col("ip_id") - known
    return df.withColumn("ip_step", F.when(step < 0, step + 65536).otherwise(step))


def ip_aggregate(cfg: Config) -> Columns:
    out: Columns = {}
    for name, forward in SIDES:
        v = only("ip_ttl", side(forward))
        out |= {f"i_{name}_min": F.min(v), f"i_{name}_max": F.max(v), f"i_{name}_avg": F.avg(v), f"i_{name}_kinds": kinds(v)}
    return out | {
        "i_first": first("ip_ttl", fwd() & F.col("ip_ttl").isNotNull()),
        "i_tos": F.min("ip_tos"),
        "i_toses": kinds("ip_tos"),
        "i_flags": F.bit_or("ip_flags"),
        "i_df": count(F.col("ip_flags").bitwiseAND(F.lit(2)) != 0),
        "i_n": F.count(F.lit(1)),
        "i_version": F.min("ip_version"),
        "i_gaps": count(F.col("ip_step") > 1),
    }


def ip_finish(cfg: Config) -> Columns:
    c = F.col
    out: Columns = {}
    for name, _ in SIDES:
        out |= {f"ip_ttl_{name}_min": or_zero(c(f"i_{name}_min")), f"ip_ttl_{name}_max": or_zero(c(f"i_{name}_max")), f"ip_ttl_{name}_mean": real(c(f"i_{name}_avg"))}
        out[f"ip_ttl_{name}_changes"] = F.greatest(c(f"i_{name}_kinds") - 1, F.lit(0))
    start = F.when(c("i_first") <= 64, 64).when(c("i_first") <= 128, 128).when(c("i_first").isNotNull(), 255).otherwise(0)
    tos = or_zero(c("i_tos"))
    return out | {
        "ip_ttl_fwd_initial_est": start,
        "ip_ttl_fwd_hops_est": or_zero(start - c("i_first")),
        "ip_tos_value": tos,
        "ip_tos_unique_count": c("i_toses"),
        "ip_dscp": F.shiftright(tos, 2),
        "ip_ecn": tos.bitwiseAND(F.lit(3)),
        "ip_flags": or_zero(c("i_flags")),
        "ip_df_count": c("i_df"),
        "ip_df_ratio": c("i_df") / c("i_n"),
        "ip_version": F.coalesce("i_version", F.lit(4)),
        "ip_id_gaps": c("i_gaps"),
    }


def ipv6_aggregate(cfg: Config) -> Columns:
    six = F.col("ip_version") == 6
    label, kind = only("ipv6_flow_label", six), only("ipv6_traffic_class", six)
    return {"v_6": count(six), "v_4": count(F.col("ip_version") == 4), "v_label": F.min(label), "v_labels": kinds(label), "v_class": F.min(kind), "v_classes": kinds(kind)}


def ipv6_finish(cfg: Config) -> Columns:
    c = F.col
    tc = or_zero(c("v_class"))
    return {
        "ipv6_packet_count": c("v_6"),
        "ipv4_packet_count": c("v_4"),
        "ipv6_flow_label": or_zero(c("v_label")),
        "ipv6_flow_label_unique_count": c("v_labels"),
        "ipv6_flow_label_changes": F.greatest(c("v_labels") - 1, F.lit(0)),
        "ipv6_traffic_class": tc,
        "ipv6_traffic_class_unique_count": c("v_classes"),
        "ipv6_dscp": F.shiftright(tc, 2),
        "ipv6_ecn": tc.bitwiseAND(F.lit(3)),
        "ipv6_ratio": ratio(c("v_6"), c("v_4") + c("v_6")),
        "is_ipv6_only": as_int((c("v_4") == 0) & (c("v_6") > 0)),
    }


#: ICMP types.
ECHO_REPLY, UNREACHABLE, REDIRECT, ECHO_REQUEST, TIME_EXCEEDED = 0, 3, 5, 8, 11


def icmp_prepare(df: DataFrame, cfg: Config) -> DataFrame:
    """How often a packet's type occurs in its session and where first, and the step between neighbouring sequence numbers."""
    same = Window.partitionBy(*SESSION, "icmp_type")
    by_value = Window.partitionBy(*SESSION).orderBy(F.col("icmp_seq").asc_nulls_last())
    return df.withColumns({"icmp_n": F.when(F.col("icmp_type").isNotNull(), F.count(F.lit(1)).over(same)), "icmp_first": F.min("pos").over(same), "icmp_step": F.col("icmp_seq") - F.lag("icmp_seq").over(by_value)})


def icmp_aggregate(cfg: Config) -> Columns:
    t = F.col("icmp_type")
    return {
        "h_n": F.count(F.lit(1)),
        "h_icmp": F.count("icmp_type"),
        "h_req": count(t == ECHO_REQUEST),
        "h_rep": count(t == ECHO_REPLY),
        "h_unr": count(t == UNREACHABLE),
        "h_exc": count(t == TIME_EXCEEDED),
        "h_red": count(t == REDIRECT),
        "h_kinds": kinds(F.when(t.isNotNull() & F.col("icmp_code").isNotNull(), F.struct("icmp_type", "icmp_code"))),
        "h_mode": F.max_by("icmp_type", F.when(t.isNotNull(), F.struct(F.col("icmp_n"), -F.col("icmp_first")))),
        "h_mode_n": F.max("icmp_n"),
        "h_ids": kinds("icmp_id"),
        "h_lo": F.min("icmp_seq"),
        "h_hi": F.max("icmp_seq"),
        "h_gaps": count(F.col("icmp_step") > 1),
    }


def icmp_finish(cfg: Config) -> Columns:
    c = F.col
    other = c("h_icmp") - c("h_req") - c("h_rep") - c("h_unr") - c("h_exc") - c("h_red")
    return {
        "icmp_packet_count": c("h_icmp"),
        "icmp_echo_request_count": c("h_req"),
        "icmp_echo_reply_count": c("h_rep"),
        "icmp_dest_unreachable_count": c("h_unr"),
        "icmp_time_exceeded_count": c("h_exc"),
        "icmp_unique_type_codes": c("h_kinds"),
        "icmp_dominant_type": F.coalesce("h_mode", F.lit(-1)),
        "icmp_dominant_type_count": or_zero(c("h_mode_n")),
        "icmp_echo_success_ratio": ratio(c("h_rep"), c("h_req")),
        "icmp_unique_ids": c("h_ids"),
        "icmp_seq_min": or_zero(c("h_lo")),
        "icmp_seq_max": or_zero(c("h_hi")),
        "icmp_seq_gaps": c("h_gaps"),
        "icmp_stat": bits((c("h_req") > 0, 1), (c("h_rep") > 0, 2), (c("h_unr") > 0, 4), (c("h_exc") > 0, 8), (c("h_red") > 0, 16), (other > 0, 32)),
        "icmp_ratio": c("h_icmp") / c("h_n"),
        "is_icmp_only": as_int((c("h_icmp") == c("h_n")) & (c("h_icmp") > 0)),
    }


# windows, options, MPTCP, fingerprints ------------------------------------------


def _earlier(value: Column) -> Column:
    """The last known value before this packet."""
    return F.last(value, ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, -1))


def window_prepare(df: DataFrame, cfg: Config) -> DataFrame:
    return df.withColumns({f"win_was_{name}": F.when(side(forward), _earlier(only("tcp_window", side(forward)))) for name, forward in SIDES})


def window_aggregate(cfg: Config) -> Columns:
    out: Columns = {}
    for name, forward in SIDES:
        here = side(forward)
        w, was = only("tcp_window", here), F.col(f"win_was_{name}")
        known = here & F.col("tcp_window").isNotNull()
        out |= {
            f"w_{name}_n": F.count(w),
            f"w_{name}_init": first("tcp_window", known),
            f"w_{name}_scale": first("tcp_window_scale", known & F.col("tcp_window_scale").isNotNull()),
            f"w_{name}_min": F.min(w),
            f"w_{name}_max": F.max(w),
            f"w_{name}_avg": F.avg(w),
            f"w_{name}_zero": count(w == 0),
            f"w_{name}_up": count(w > was),
            f"w_{name}_down": count(w < was),
        }
    return out


def window_finish(cfg: Config) -> Columns:
    c = F.col
    out: Columns = {}
    for name, _ in SIDES:
        k = f"w_{name}_"
        most = or_zero(c(k + "max")).cast("long")
        out |= {
            f"tcp_init_win_{name}": or_zero(c(k + "init")),
            f"tcp_win_scale_{name}": or_zero(c(k + "scale")),
            f"tcp_win_{name}_min": or_zero(c(k + "min")),
            f"tcp_win_{name}_max": most,
            f"tcp_win_{name}_mean": real(c(k + "avg")),
            f"tcp_win_{name}_zero_count": c(k + "zero"),
            f"tcp_win_{name}_up_count": c(k + "up"),
            f"tcp_win_{name}_down_count": c(k + "down"),
            f"tcp_win_{name}_change_count": c(k + "up") + c(k + "down"),
            f"tcp_scaled_win_{name}_max": (most * F.pow(F.lit(2.0), or_zero(c(k + "scale")))).cast("long"),
        }
    zero, n = c("w_fwd_zero") + c("w_bwd_zero"), c("w_fwd_n") + c("w_bwd_n")
    return out | {"tcp_zero_win_ratio": ratio(zero, n)}


def options_prepare(df: DataFrame, cfg: Config) -> DataFrame:
    """Whether a packet counts as one with options: the first segment size or scale of its side, or any of the others."""
    new = F.lit(False)
    for col in ("tcp_mss", "tcp_window_scale"):
        for _, forward in SIDES:
            new = new | (side(forward) & F.col(col).isNotNull() & _earlier(only(col, side(forward))).isNull())
    other = F.coalesce("tcp_sack_permitted", F.lit(False)) | F.col("tcp_timestamp").isNotNull() | F.col("tcp_sack_blocks").isNotNull()
    return df.withColumn("has_options", new | other)


def options_aggregate(cfg: Config) -> Columns:
    out: Columns = {"o_blocks": or_zero(F.sum(F.when(F.col("tcp_sack_blocks").isNotNull(), F.size("tcp_sack_blocks")))), "o_n": count(F.col("has_options"))}
    for name, forward in SIDES:
        here = side(forward)
        stamped = here & F.col("tcp_timestamp").isNotNull()
        out |= {
            f"o_{name}_mss": first("tcp_mss", here & F.col("tcp_mss").isNotNull()),
            f"o_{name}_ws": first("tcp_window_scale", here & F.col("tcp_window_scale").isNotNull()),
            f"o_{name}_sack": ever(F.coalesce("tcp_sack_permitted", F.lit(False)) & here),
            f"o_{name}_ts_n": count(stamped),
            f"o_{name}_ts_first": first("tcp_timestamp", stamped),
            f"o_{name}_ts_last": last("tcp_timestamp", stamped),
        }
    return out


def options_finish(cfg: Config) -> Columns:
    c = F.col
    out: Columns = {"tcp_sack_blocks_total": c("o_blocks"), "tcp_options_pkt_count": c("o_n")}
    for name, _ in SIDES:
        k = f"o_{name}_"
        head, tail = c(k + "ts_first"), c(k + "ts_last")
        passed = tail["tsval"] - head["tsval"]
        out |= {
            f"tcp_mss_{name}": or_zero(c(k + "mss")),
            f"tcp_ws_{name}": or_zero(c(k + "ws")),
            f"tcp_sack_permitted_{name}": as_int(c(k + "sack")),
            f"tcp_ts_{name}_present": as_int(c(k + "ts_n") > 0),
            f"tcp_ts_{name}_first": or_zero(head["tsval"]),
            f"tcp_ts_{name}_last": or_zero(tail["tsval"]),
            f"tcp_ts_{name}_diff": F.when(c(k + "ts_n") > 1, F.when(passed < 0, passed + WRAP).otherwise(passed)).otherwise(F.lit(0)),
            f"tcp_ts_ecr_{name}_first": or_zero(head["tsecr"]),
        }
    either = lambda s: c(f"o_fwd_{s}").isNotNull() | c(f"o_bwd_{s}").isNotNull()
    out["tcp_options_bitmap"] = bits((either("mss"), 1), (either("ws"), 2), (c("o_fwd_sack") | c("o_bwd_sack"), 4), ((c("o_fwd_ts_n") + c("o_bwd_ts_n")) > 0, 8))
    return out


def has_option(raw: Column, kind: int) -> Column:
    """Whether a TCP option of this kind is among the raw bytes, read from the left: at most 40 of them, so 40 steps at most."""
    text = F.hex(raw)
    octet = lambda at: F.conv(F.substring(text, at * 2 + 1, F.lit(2)), 16, 10).cast("int")
    size = F.length(text) / 2

    def step(s: Column, _: Column) -> Column:
        at = s["at"]
        k, n = octet(at), octet(at + 1)
        stop = F.struct(F.lit(-1).alias("at"), F.lit(False).alias("hit"))
        go = lambda to: F.struct(to.cast("int").alias("at"), F.lit(False).alias("hit"))
        return (
            F.when(s["hit"] | (at < 0), s)
            .when(at >= size, stop)
            .when(k == 0, stop)
            .when(k == 1, go(at + 1))
            .when(at + 1 >= size, stop)
            .when((n < 2) | (at + n > size), stop)
            .when(k == kind, F.struct(at.alias("at"), F.lit(True).alias("hit")))
            .otherwise(go(at + n))
        )

    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"))
    return F.coalesce(F.aggregate(F.sequence(F.lit(1), F.lit(41)), start, step, lambda s: s["hit"]), F.lit(False))


def mptcp_prepare(df: DataFrame, cfg: Config) -> DataFrame:
    return df.withColumn("mptcp", F.when(F.col("tcp_options_raw").isNotNull(), has_option(F.col("tcp_options_raw"), 30)).otherwise(F.lit(False)))


def mptcp_aggregate(cfg: Config) -> Columns:
    m = F.col("mptcp")
    return {"q_n": count(m), "q_f": ever(m & flag(SYN) & fwd()), "q_b": ever(m & flag(SYN) & bwd())}


def mptcp_finish(cfg: Config) -> Columns:
    c = F.col
    both = c("q_f") & c("q_b")
    return {
        "mptcp_detected": as_int(c("q_n") > 0),
        "mptcp_capable_fwd": as_int(c("q_f")),
        "mptcp_capable_bwd": as_int(c("q_b")),
        "mptcp_option_count": c("q_n"),
        "mptcp_stat": bits((c("q_n") > 0, 1), (c("q_f"), 2), (c("q_b"), 4), (both, 8)),
        "is_mptcp": as_int(both),
    }


def fp_aggregate(cfg: Config) -> Columns:
    seen = F.struct(
        or_zero(F.col("tcp_window")).alias("win"),
        or_zero(F.col("ip_ttl")).alias("ttl"),
        or_zero(F.col("tcp_mss")).alias("mss"),
        or_zero(F.col("tcp_window_scale")).alias("ws"),
        bits((F.coalesce("tcp_sack_permitted", F.lit(False)), 1), (F.col("tcp_timestamp").isNotNull(), 2)).alias("opt"),
    )
    out = {"g_fwd": first(seen, flag(SYN) & ~flag(ACK) & fwd()), "g_bwd": first(seen, flag(SYN) & flag(ACK) & bwd())}
    for name, forward in SIDES:
        out[f"g_ts_{name}"] = first(F.col("tcp_timestamp")["tsval"], side(forward) & F.col("tcp_timestamp").isNotNull())
    return out


def fp_finish(cfg: Config) -> Columns:
    out: Columns = {}
    for name, _ in SIDES:
        g = F.col(f"g_{name}")
        text = lambda *parts: F.concat_ws("_", *(p.cast("string") for p in parts))
        digest = F.substring(F.md5(text(g["win"], g["ttl"], g["mss"], g["ws"], g["opt"]).cast("binary")), 1, 12)
        ttl, win = g["ttl"], g["win"]
        # fixed values: start values of time to live and windows by system; the last of the rules for 64 can't be reached
        os = (
            F.when(g.isNull(), "unknown")
            .when((ttl <= 64) & win.isin(29200, 65535), "linux")
            .when((ttl <= 64) & (win == 5840), "linux-old")
            .when((ttl > 64) & (ttl <= 128) & win.isin(65535, 8192), "windows")
            .when((ttl > 64) & (ttl <= 128) & (win == 65520), "windows-10")
            .when(ttl > 128, "bsd")
            .otherwise("unknown")
        )
        out |= {
            f"tcp_fp_{name}": F.when(g.isNull(), F.lit("")).otherwise(F.concat(F.lit("t"), text(win, g["mss"], g["ws"]), F.lit("_"), digest)),
            f"tcp_os_hint_{name}": os,
            f"tcp_uptime_{name}": real(F.col(f"g_ts_{name}") / 100.0 / 3600.0),
        }
        out |= {f"tcp_fp_{name}_{long}": or_zero(g[k]) for long, k in (("window", "win"), ("ttl", "ttl"), ("mss", "mss"), ("ws", "ws"))}
    return out


# sequences and round trips -----------------------------------------------------


def sequence_prepare(df: DataFrame, cfg: Config) -> DataFrame:
    """Retransmissions and repeated acknowledgements, each against the earlier packets of its direction."""
    sent = F.col("tcp_seq").isNotNull() & (F.col("payload_len") > 0)
    same = Window.partitionBy(*SESSION, "fwd", "tcp_seq").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("again", sent & (or_zero(F.count(F.when(sent, 1)).over(same)) > 0))
    acked = F.col("tcp_seq").isNotNull() & F.col("tcp_ack").isNotNull()
    was = {f"ack_was_{name}": F.when(side(forward) & acked, _earlier(F.when(acked & side(forward), F.col("tcp_ack")))) for name, forward in SIDES}
    return df.withColumns(was).withColumn("acked", acked)


def sequence_aggregate(cfg: Config) -> Columns:
    out: Columns = {"e_n": F.count("tcp_seq")}
    for name, forward in SIDES:
        here = side(forward) & F.col("tcp_seq").isNotNull()
        out |= {
            f"e_{name}_isn": first("tcp_seq", here),
            f"e_{name}_bytes": or_zero(F.sum(only("payload_len", here & ~F.col("again")))),
            f"e_{name}_again": count(here & F.col("again")),
            f"e_{name}_acks": count(side(forward) & F.col("acked")),
            f"e_{name}_dup": count(F.col("tcp_ack") == F.col(f"ack_was_{name}")),
            f"e_{name}_list": F.array_sort(F.collect_list(only(F.struct("pos", "tcp_seq", "payload_len"), here))),
        }
    return out


def sequence_fold(packets: Column) -> Column:
    """Gaps and packets out of order of one direction: (next expected number, gaps, late) folded over its packets."""

    def step(s: Column, p: Column) -> Column:
        want = F.coalesce(s["want"], p["tcp_seq"])
        off = F.pmod(p["tcp_seq"] - want, F.lit(WRAP))
        after = F.pmod(p["tcp_seq"] + F.greatest(p["payload_len"], F.lit(1)), F.lit(WRAP))
        ahead = F.pmod(after - want, F.lit(WRAP)) < WRAP // 2
        return F.struct(
            F.when(ahead, after).otherwise(want).alias("want"),
            (s["gaps"] + ((off > 0) & (off < WRAP // 2)).cast("long")).alias("gaps"),
            (s["late"] + (off > WRAP // 2).cast("long")).alias("late"),
        )

    start = F.struct(F.lit(None).cast("long").alias("want"), F.lit(0).cast("long").alias("gaps"), F.lit(0).cast("long").alias("late"))
    return F.aggregate(packets, start, step)


def sequence_finish(cfg: Config) -> Columns:
    c = F.col
    out: Columns = {}
    folds = {name: sequence_fold(c(f"e_{name}_list")) for name, _ in SIDES}
    for name, _ in SIDES:
        out |= {
            f"tcp_isn_{name}": or_zero(c(f"e_{name}_isn")),
            f"tcp_seq_{name}_bytes_sent": c(f"e_{name}_bytes"),
            f"tcp_seq_{name}_retrans": c(f"e_{name}_again"),
            f"tcp_seq_{name}_gaps": folds[name]["gaps"],
            f"tcp_seq_{name}_ooo": folds[name]["late"],
            f"tcp_ack_{name}_count": c(f"e_{name}_acks"),
            f"tcp_ack_{name}_dup": c(f"e_{name}_dup"),
        }
    again = c("e_fwd_again") + c("e_bwd_again")
    return out | {
        "tcp_total_retrans": again,
        "tcp_total_ooo": folds["fwd"]["late"] + folds["bwd"]["late"],
        "tcp_total_dup_acks": c("e_fwd_dup") + c("e_bwd_dup"),
        "tcp_retrans_ratio": ratio(again, c("e_n")),
    }


def rtt_prepare(df: DataFrame, cfg: Config) -> DataFrame:
    """Round trips, each by an as-of match on a key within the session, in window functions alone.

    An echo meets the latest earlier packet of the other direction that sent its stamp: both sides are lined up by the
    stamp. Data and the acknowledgement of its end are lined up by that number; of acknowledgements with no data between, only the first counts.
    """
    stamp = F.col("tcp_timestamp")
    # a packet's own stamp and its echo are two roles: the rows are doubled, lined up, and put together again by packet
    order = Window.partitionBy(*SESSION, "lane", "key").orderBy("ord", "role").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.pmod(F.col("tcp_seq") + F.col("payload_len"), F.lit(WRAP))
    roles = F.array(
        F.when(stamp.isNotNull(), F.struct(F.lit("s").alias("what"), F.lit(0).alias("role"), F.col("fwd").alias("lane_fwd"), stamp["tsval"].alias("key"))),
        F.when(stamp.isNotNull() & (stamp["tsecr"] != 0), F.struct(F.lit("s").alias("what"), F.lit(1).alias("role"), (~F.col("fwd")).alias("lane_fwd"), stamp["tsecr"].alias("key"))),
        F.when(F.col("tcp_seq").isNotNull() & (F.col("payload_len") > 0), F.struct(F.lit("a").alias("what"), F.lit(0).alias("role"), F.col("fwd").alias("lane_fwd"), ended.alias("key"))),
        F.when(F.col("tcp_seq").isNotNull() & F.col("tcp_ack").isNotNull(), F.struct(F.lit("a").alias("what"), F.lit(1).alias("role"), (~F.col("fwd")).alias("lane_fwd"), F.col("tcp_ack").alias("key"))),
        F.struct(F.lit("-").alias("what"), F.lit(2).alias("role"), F.col("fwd").alias("lane_fwd"), F.lit(None).cast("long").alias("key")),
    )
    each = df.withColumn("r", F.explode(F.filter(roles, lambda r: r.isNotNull()))).select("*", "r.role", "r.key", F.concat(F.col("r.what"), F.col("r.lane_fwd").cast("string")).alias("lane")).drop("r")
    sent = F.last(F.when(F.col("role") == 0, F.col("ts_us")), ignorenulls=True).over(order)
    each = each.withColumns({"sent": sent, "before_role": F.last("role").over(order)})
    trip = F.col("ts_us") - F.col("sent")
    fits = (F.col("role") == 1) & (trip > 0) & (trip < 60_000_000)
    stamped, acked = F.col("lane").startswith("s"), F.col("lane").startswith("a")
    each = each.withColumns({"rtt_s": F.when(fits & stamped, trip), "rtt_a": F.when(fits & acked & (F.col("before_role") == 0), trip)})
    packet = Window.partitionBy(*SESSION, "ord")
    whole = each.withColumns({"rtt_stamp": F.max("rtt_s").over(packet), "rtt_ack": F.max("rtt_a").over(packet)}).where("role = 2")
    whole = whole.drop("role", "key", "lane", "sent", "before_role", "rtt_s", "rtt_a")
    ack = flag(ACK) & ~flag(SYN) & fwd()
    answered = F.max((flag(SYN) & flag(ACK) & bwd()).cast("int")).over(in_order().rowsBetween(Window.unboundedPreceding, -1)) == 1
    return whole.withColumns({"rtt_step": F.abs(F.col("rtt_stamp") - _earlier(F.col("rtt_stamp"))), "shook": ack & F.coalesce(answered, F.lit(False))})


def rtt_aggregate(cfg: Config) -> Columns:
    out: Columns = {"r_syn": first("ts_us", flag(SYN) & ~flag(ACK) & fwd()), "r_synack": first("ts_us", flag(SYN) & flag(ACK) & bwd()), "r_ack": first("ts_us", F.col("shook"))}
    for k in ("rtt_stamp", "rtt_ack"):
        out |= {f"r_{k}_min": F.min(k), f"r_{k}_max": F.max(k), f"r_{k}_avg": F.avg(k)}
    return out | {"r_n": F.count("rtt_stamp"), "r_std": F.stddev_pop("rtt_stamp"), "r_step": F.avg("rtt_step")}


def rtt_finish(cfg: Config) -> Columns:
    c = F.col
    sec = lambda x: real(x / 1e6)
    return {
        "tcp_rtt_handshake": sec(F.coalesce(c("r_ack") - c("r_syn"), (c("r_synack") - c("r_syn")) * 2)),
        "tcp_rtt_min": sec(c("r_rtt_stamp_min")),
        "tcp_rtt_max": sec(c("r_rtt_stamp_max")),
        "tcp_rtt_mean": sec(c("r_rtt_stamp_avg")),
        "tcp_rtt_samples": c("r_n"),
        "tcp_rtt_std": sec(c("r_std")),
        "tcp_rtt_jitter_avg": sec(c("r_step")),
        "tcp_rtt_ack_min": sec(c("r_rtt_ack_min")),
        "tcp_rtt_ack_max": sec(c("r_rtt_ack_max")),
        "tcp_rtt_ack_mean": sec(c("r_rtt_ack_avg")),
    }


GROUPS = (
    Group("tcp", "core", tcp_aggregate, tcp_finish),
    Group("mac", "experimental", mac_aggregate, mac_finish),
    Group("ip_extended", "extended", ip_aggregate, ip_finish, ip_prepare),
    Group("ipv6_options", "experimental", ipv6_aggregate, ipv6_finish),
    Group("icmp", "experimental", icmp_aggregate, icmp_finish, icmp_prepare),
    Group("tcp_sequence", "extended", sequence_aggregate, sequence_finish, sequence_prepare),
    Group("tcp_window", "extended", window_aggregate, window_finish, window_prepare),
    Group("tcp_options", "extended", options_aggregate, options_finish, options_prepare),
    Group("tcp_mptcp", "experimental", mptcp_aggregate, mptcp_finish, mptcp_prepare),
    Group("tcp_rtt", "extended", rtt_aggregate, rtt_finish, rtt_prepare),
    Group("tcp_fingerprint", "experimental", fp_aggregate, fp_finish),
)
