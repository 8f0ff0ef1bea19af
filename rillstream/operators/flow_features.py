"""Feature groups of any traffic: flow metadata, timing, sizes, padding and traffic fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.columns import bits, count, ever, first, flow_id, hashed_ip, kinds, only, or_zero, percentiles, port_class, ratio, real
from ..schema import ACK, FIN, RST, SYN, flag
from .base import Columns, Group
from .sessionize import SESSION


def fwd() -> Column:
    return F.col("fwd")


def bwd() -> Column:
    return ~F.col("fwd")


def in_order() -> Window:
    return Window.partitionBy(*SESSION).orderBy("ord")


# flow_meta ------------------------------------------------------------------


def meta_aggregate(cfg: Config) -> Columns:
    return {
        "m_src_ip": first("src_ip"),
        "m_dst_ip": first("dst_ip"),
        "m_src_port": first("src_port"),
        "m_dst_port": first("dst_port"),
        "m_start": F.min_by("ts_us", "pos"),
        "m_end": F.max_by("ts_us", "pos"),
        "m_n": F.count(F.lit(1)),
        "m_nf": count(fwd()),
        "m_bytes": or_zero(F.sum("total_len")),
        "m_bytes_f": or_zero(F.sum(only("total_len", fwd()))),
        "m_bytes_b": or_zero(F.sum(only("total_len", bwd()))),
        "m_pay_f": or_zero(F.sum(only("payload_len", fwd()))),
        "m_pay_b": or_zero(F.sum(only("payload_len", bwd()))),
        "m_mac": first("src_mac"),
        "m_version": first("ip_version"),
        "m_syn": ever(flag(SYN) & ~flag(ACK)),
        "m_synack": ever(flag(SYN) & flag(ACK)),
        "m_fin_f": ever(flag(FIN) & fwd()),
        "m_fin_b": ever(flag(FIN) & bwd()),
        "m_rst": ever(flag(RST)),
    }


def meta_finish(cfg: Config) -> Columns:
    c = F.col
    out: Columns = {}
    if cfg.include_flow_id:
        out["flow_id"] = flow_id(cfg.anonymization_salt)
    if cfg.include_ip_addresses:
        for name in ("src_ip", "dst_ip"):
            out[name] = hashed_ip(c(f"m_{name}"), cfg.anonymization_salt) if cfg.anonymize_ips else c(f"m_{name}")
    if cfg.include_ports:
        name, number = port_class(c("m_dst_port"))
        out |= {"src_port": c("m_src_port"), "dst_port": c("m_dst_port"), "dst_port_class": name, "dst_port_class_num": number}
    duration = (c("m_end") - c("m_start")) / 1e6
    nb, n, size = c("m_n") - c("m_nf"), c("m_n"), c("m_bytes")
    start, end = c("m_start") / 1e6, c("m_end") / 1e6
    proto = F.when(c("protocol") == 6, F.lit("TCP")).when(c("protocol") == 17, F.lit("UDP")).when(c("protocol") == 1, F.lit("ICMP")).otherwise(F.concat(F.lit("PROTO"), c("protocol").cast("string")))
    eth = F.when(F.coalesce(c("m_mac"), F.lit("")) != "", F.lit("ETH"))
    layers = F.concat_ws("-", eth, F.when(F.coalesce(c("m_version"), F.lit(4)) == 6, F.lit("IP6")).otherwise(F.lit("IP")), proto)
    proper = c("m_syn") & c("m_synack") & ((c("m_fin_f") & c("m_fin_b")) | c("m_rst"))
    return out | {
        "protocol": c("protocol"),
        "start_time": start,
        "end_time": end,
        "duration": duration,
        "total_packets": n,
        "packets_fwd": c("m_nf"),
        "packets_bwd": nb,
        "total_bytes": size,
        "bytes_fwd": c("m_bytes_f"),
        "bytes_bwd": c("m_bytes_b"),
        "payload_bytes_fwd": c("m_pay_f"),
        "payload_bytes_bwd": c("m_pay_b"),
        "payload_bytes_total": c("m_pay_f") + c("m_pay_b"),
        "packets_ratio": ratio(c("m_nf"), nb, c("m_nf").cast("double")),
        "bytes_ratio": ratio(c("m_bytes_f"), c("m_bytes_b"), F.greatest(c("m_bytes_f"), F.lit(0)).cast("double")),
        "packets_per_second": ratio(n, duration, n.cast("double")),
        "bytes_per_second": ratio(size, duration, size.cast("double")),
        "avg_packet_size": ratio(size, n),
        "time_first": start,
        "time_last": end,
        "flow_stat": bits((c("m_syn"), 1), (c("m_synack"), 2), (c("m_fin_f"), 4), (c("m_fin_b"), 8), (c("m_rst"), 16), (proper, 64)),
        "num_hdrs": F.size(F.split(layers, "-")),
        "hdr_desc": layers,
    }


# timing ---------------------------------------------------------------------


def timing_prepare(df: DataFrame, cfg: Config) -> DataFrame:
    """Gaps to the packet before, at all and in the same direction, and the places of packets in their bursts."""
    w = in_order()
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    ts = F.col("ts_us")
    df = df.withColumns(
        {
            "iat": ts - F.lag("ts_us").over(w),
            "iat_f": F.when(fwd(), ts - F.last(F.when(fwd(), ts), ignorenulls=True).over(earlier)),
            "iat_b": F.when(bwd(), ts - F.last(F.when(bwd(), ts), ignorenulls=True).over(earlier)),
        }
    )
    starts = F.col("iat").isNull() | (F.col("iat") >= cfg.burst_us)
    return df.withColumn("burst_place", F.col("pos") - F.max(F.when(starts, F.col("pos"))).over(so_far) + 1)


def timing_aggregate(cfg: Config) -> Columns:
    idle = F.col("iat") >= cfg.burst_us
    out: Columns = {"t_q": percentiles(F.col("iat"), [0.25, 0.5, 0.75, 0.9, 0.99])}
    for k in ("iat", "iat_f", "iat_b"):
        c = F.col(k)
        out |= {f"t_{k}_min": F.min(c), f"t_{k}_max": F.max(c), f"t_{k}_sum": F.sum(c), f"t_{k}_avg": F.avg(c), f"t_{k}_std": F.stddev_pop(c)}
        if k != "iat":
            out[f"t_{k}_median"] = F.percentile(c, F.lit(0.5))
    out |= {
        "t_n": F.count("iat"),
        "t_idle": count(idle),
        "t_idle_sum": F.sum(only("iat", idle)),
        "t_idle_max": F.max(only("iat", idle)),
        "t_in_bursts": F.sum(only("iat", ~idle)),
        "t_burst_max": F.max("burst_place"),
        "t_start": F.min_by("ts_us", "pos"),
        "t_reply": first("ts_us", bwd()),
        "t_packets": F.count(F.lit(1)),
    }
    if cfg.include_raw_sequences or cfg.include_splt:
        # at most the first packets: what is gathered of a session is bounded
        head = F.col("pos") <= cfg.max_sequence_length
        out["t_head"] = F.array_sort(F.collect_list(only(F.struct("pos", "ts_us", "iat", "total_len", "fwd"), head)))
    return out


def _zero_padded(values: Column, n: int, zero: Column) -> Column:
    return F.slice(F.concat(values, F.array_repeat(zero, n)), 1, n)


def timing_finish(cfg: Config) -> Columns:
    c = F.col
    sec = lambda x: real(x / 1e6)
    out = {"iat_min": sec(c("t_iat_min")), "iat_max": sec(c("t_iat_max")), "iat_mean": sec(c("t_iat_avg")), "iat_std": sec(c("t_iat_std")), "iat_median": sec(c("t_q")[1]), "iat_sum": sec(c("t_iat_sum"))}
    out |= {"iat_p25": sec(c("t_q")[0]), "iat_p75": sec(c("t_q")[2]), "iat_p90": sec(c("t_q")[3]), "iat_p99": sec(c("t_q")[4])}
    for side, k in (("fwd", "iat_f"), ("bwd", "iat_b")):
        out |= {f"iat_{side}_{s}": sec(c(f"t_{k}_{a}")) for s, a in (("min", "min"), ("max", "max"), ("mean", "avg"), ("std", "std"), ("median", "median"))}
    for name, k in (("burstiness_index", "iat"), ("burstiness_index_fwd", "iat_f"), ("burstiness_index_bwd", "iat_b")):
        out[name] = F.when(c(f"t_{k}_avg") != 0, c(f"t_{k}_std") / c(f"t_{k}_avg")).otherwise(F.lit(0.0))
    some = c("t_n") > 0
    bursts = c("t_idle") + 1
    out |= {
        "burst_count": F.when(some, bursts).otherwise(F.lit(0)),
        "avg_burst_packets": F.when(some, c("t_packets") / bursts).otherwise(F.lit(0.0)),
        "avg_burst_duration": F.when(some, real(c("t_in_bursts")) / 1e6 / bursts).otherwise(F.lit(0.0)),
        "max_burst_packets": F.when(some, c("t_burst_max")).otherwise(F.lit(0)),
        "idle_count": c("t_idle"),
        "avg_idle_duration": ratio(or_zero(c("t_idle_sum")) / 1e6, c("t_idle")),
        "max_idle_duration": sec(c("t_idle_max")),
        "first_response_time": sec(c("t_reply") - c("t_start")),
    }
    n = cfg.max_sequence_length
    if cfg.include_raw_sequences:
        out["iat_sequence"] = _zero_padded(F.transform(F.filter("t_head", lambda p: p["iat"].isNotNull()), lambda p: p["iat"] / 1e6), n, F.lit(0.0))
        out["timestamp_sequence"] = _zero_padded(F.transform("t_head", lambda p: (p["ts_us"] - c("t_start")) / 1e6), n, F.lit(0.0))
    if cfg.include_splt:
        way = lambda p: F.when(p["fwd"], F.lit(1)).otherwise(F.lit(-1))
        gap = lambda p: F.coalesce(p["iat"] / 1e6, F.lit(0.0))
        out["splt"] = F.transform("t_head", lambda p: F.struct(p["total_len"].alias("len"), gap(p).alias("iat"), way(p).alias("dir")))
        out |= {"splt_lengths": F.transform("t_head", lambda p: p["total_len"]), "splt_times": F.transform("t_head", gap), "splt_directions": F.transform("t_head", way)}
    return out


# size -----------------------------------------------------------------------


def size_prepare(df: DataFrame, cfg: Config) -> DataFrame:
    """How often a packet's size occurs in its session, and where first."""
    same = Window.partitionBy(*SESSION, "total_len")
    return df.withColumns({"size_n": F.count(F.lit(1)).over(same), "size_first": F.min("pos").over(same)})


def size_aggregate(cfg: Config) -> Columns:
    out: Columns = {"s_q": percentiles(F.col("total_len"), [0.25, 0.5, 0.75, 0.9])}
    for k, cond in (("", None), ("_f", fwd()), ("_b", bwd())):
        for name, col in (("len", "total_len"), ("pay", "payload_len")):
            v = only(col, cond)
            out |= {f"s_{name}{k}_min": F.min(v), f"s_{name}{k}_max": F.max(v), f"s_{name}{k}_avg": F.avg(v), f"s_{name}{k}_std": F.stddev_pop(v), f"s_{name}{k}_sum": or_zero(F.sum(v)), f"s_{name}{k}_n": F.count(v)}
        with_ = F.col("payload_len") > 0
        some = with_ if cond is None else with_ & cond
        out |= {f"s_with{k}": count(some), f"s_some{k}_min": F.min(only("payload_len", some)), f"s_some{k}_max": F.max(only("payload_len", some))}
        if k:
            out[f"s_len{k}_median"] = F.percentile(only("total_len", cond), F.lit(0.5))
    out |= {"s_n": F.count(F.lit(1)), "s_var": F.var_pop("total_len"), "s_mode": F.max_by("total_len", F.struct(F.col("size_n"), -F.col("size_first"))), "s_mode_n": F.max("size_n")}
    if cfg.include_raw_sequences:
        signed = F.when(F.col("src_ip") == F.col("init_ip"), F.col("total_len")).otherwise(-F.col("total_len"))
        out["s_head"] = F.array_sort(F.collect_list(only(F.struct(F.col("pos"), signed.alias("len")), F.col("pos") <= cfg.max_sequence_length)))
    return out


def size_finish(cfg: Config) -> Columns:
    c = F.col
    out: Columns = {}
    for k, side in (("", ""), ("_f", "fwd_"), ("_b", "bwd_")):
        out |= {f"pkt_len_{side}{s}": real(c(f"s_len{k}_{a}")) for s, a in (("min", "min"), ("max", "max"), ("mean", "avg"), ("std", "std"))}
        out[f"pkt_len_{side}median"] = real(c(f"s_len{k}_median") if k else c("s_q")[1])
        stats = (("min", "min"), ("max", "max"), ("mean", "avg"), ("std", "std")) if not k else (("mean", "avg"), ("std", "std"))
        out |= {f"payload_len_{side}{s}": real(c(f"s_pay{k}_{a}")) for s, a in stats}
    out |= {"pkt_len_p25": real(c("s_q")[0]), "pkt_len_p75": real(c("s_q")[2]), "pkt_len_p90": real(c("s_q")[3])}
    out |= {"packets_with_payload": c("s_with"), "packets_with_payload_fwd": c("s_with_f"), "packets_with_payload_bwd": c("s_with_b")}
    out |= {
        "header_only_ratio": (c("s_n") - c("s_with")) / c("s_n"),
        "pkt_len_variance": real(c("s_var")),
        "dominant_pkt_size": c("s_mode"),
        "dominant_pkt_ratio": c("s_mode_n") / c("s_n"),
        "l7_bytes_fwd": c("s_pay_f_sum"),
        "l7_bytes_bwd": c("s_pay_b_sum"),
        "l7_bytes_total": c("s_pay_f_sum") + c("s_pay_b_sum"),
    }
    for side in ("fwd", "bwd"):
        out |= {f"l7_pkt_{s}_{side}": or_zero(c(f"s_some_{side[0]}_{s}")) for s in ("min", "max")}
    out |= {"pkt_asymmetry": (c("s_len_f_n") - c("s_len_b_n")) / c("s_n"), "byte_asymmetry": ratio(c("s_len_f_sum") - c("s_len_b_sum"), c("s_len_sum"))}
    if cfg.include_raw_sequences:
        out["pkt_len_sequence"] = _zero_padded(F.transform("s_head", lambda p: p["len"]), cfg.max_sequence_length, F.lit(0))
    return out


# padding --------------------------------------------------------------------

#: Gap that ends a burst, share of one size and variation of gaps that count as constant, sizes of cells.
PAD_BURST_US, CONSTANT_SIZE, CONSTANT_RATE, CELLS, CELL_SHARE, UNIFORM = 50_000, 0.95, 0.1, (580, 600), 0.7, 0.1


def padding_prepare(df: DataFrame, cfg: Config) -> DataFrame:
    """Payload and size of each burst, on its last packet."""
    w = in_order()
    df = df.withColumn("pad_no", F.sum(F.when(F.coalesce(F.col("iat"), F.lit(0)) >= PAD_BURST_US, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    burst = Window.partitionBy(*SESSION, "pad_no")
    tail = F.coalesce(F.lead("iat").over(w), F.lit(PAD_BURST_US)) >= PAD_BURST_US
    sums = F.struct(F.sum("payload_len").over(burst).alias("pay"), F.sum("total_len").over(burst).alias("all"))
    return df.withColumn("pad_tail", tail).withColumn("pad_burst", sums)


def padding_aggregate(cfg: Config) -> Columns:
    tail = F.col("pad_tail") & (F.col("pad_burst.all") > 0)
    return {
        "p_n": F.count(F.lit(1)),
        "p_var": F.var_pop("total_len"),
        "p_std": F.stddev_pop("total_len"),
        "p_avg": F.avg("total_len"),
        "p_mode": F.max_by("total_len", F.struct(F.col("size_n"), -F.col("size_first"))),
        "p_mode_n": F.max("size_n"),
        "p_kinds": kinds("total_len"),
        "p_log": F.avg(F.log2(F.col("size_n").cast("double"))),
        "p_iat_var": F.var_pop("iat"),
        "p_iat_std": F.stddev_pop("iat"),
        "p_iat_avg": F.avg("iat"),
        "p_cells": count(F.col("total_len").between(*CELLS)),
        "p_over": or_zero(F.sum(F.col("total_len").cast("long") - F.col("payload_len"))),
        "p_all": or_zero(F.sum("total_len")),
        "p_eff": F.avg(only(F.col("pad_burst.pay") / F.col("pad_burst.all"), tail)),
    }


def padding_finish(cfg: Config) -> Columns:
    c = F.col
    several, n = c("p_n") > 1, c("p_n").cast("double")
    cv = ratio(c("p_std"), c("p_avg"))
    share = c("p_mode_n") / n
    entropy = F.when(c("p_kinds") > 1, (F.log2(n) - c("p_log")) / F.log2(c("p_kinds").cast("double"))).otherwise(F.lit(0.0))
    iat_cv = F.when(several, ratio(c("p_iat_std"), c("p_iat_avg"))).otherwise(F.lit(0.0))
    constant, steady = share >= CONSTANT_SIZE, several & (iat_cv <= CONSTANT_RATE)
    cells = c("p_cells") / n
    tor = (cells >= CELL_SHARE) & (~several | (cv < UNIFORM))
    score = F.when(constant, 0.3).otherwise(0.0) + F.when(share > 0.8, 0.2).otherwise(0.0) + F.when(steady, 0.2).otherwise(0.0) + F.when(tor, 0.3).otherwise(0.0)
    return {
        "pkt_size_variance": real(c("p_var")),
        "pkt_size_cv": cv,
        "is_constant_size": constant,
        "dominant_size_mode": c("p_mode"),
        "dominant_size_ratio": share,
        "unique_size_count": c("p_kinds"),
        "size_entropy": entropy,
        "iat_variance": real(c("p_iat_var") / 1e12),
        "iat_cv": iat_cv,
        "is_constant_rate": steady,
        "tor_cell_count": c("p_cells"),
        "tor_cell_ratio": cells,
        "is_tor_like": tor,
        "burst_padding_ratio": F.when(several, ratio(c("p_over"), c("p_all"))).otherwise(F.lit(0.0)),
        "burst_overhead_bytes": F.when(several, c("p_over")).otherwise(F.lit(0)),
        "avg_burst_payload_efficiency": F.when(several, F.coalesce(c("p_eff"), F.lit(1.0))).otherwise(F.lit(1.0)),
        "padding_score": F.least(F.lit(1.0), score),
    }


# fingerprint ----------------------------------------------------------------

#: Ports of relays and tunnels, and the weights of the signs.
TOR_PORTS = (443, 9001, 9030, 9050, 9051)


def fingerprint_aggregate(cfg: Config) -> Columns:
    size = F.col("total_len")
    return {
        "f_n": F.count(F.lit(1)),
        "f_nf": count(fwd()),
        "f_cells": count(size.between(*CELLS)),
        "f_large": count(size.between(1400, 1500)),
        "f_std": F.stddev_pop(size),
        "f_avg": F.avg(size),
        "f_src_port": first("src_port"),
        "f_dst_port": first("dst_port"),
        "f_ask_max": F.max(only(size, fwd())),
        "f_ask": or_zero(F.sum(only(size, fwd()))),
        "f_reply": or_zero(F.sum(only(size, bwd()))),
        "f_start": F.min_by("ts_us", "pos"),
        "f_end": F.max_by("ts_us", "pos"),
    }


def fingerprint_finish(cfg: Config) -> Columns:
    c = F.col

    def weight(cond: Column, w: float) -> Column:
        return F.when(cond, F.lit(w)).otherwise(F.lit(0.0))

    n, proto, dport, sport = c("f_n"), c("protocol"), c("f_dst_port"), c("f_src_port")
    cv = ratio(c("f_std"), c("f_avg"), 1.0)
    tor = weight(c("f_cells") / n > 0.7, 0.4) + weight(cv < 0.1, 0.3) + weight(dport.isin(*TOR_PORTS), 0.1)
    udp = proto == 17
    signs = [
        (udp & ((dport == 1194) | (sport == 1194)), 0.5, "openvpn"),
        (udp & (dport == 51820), 0.5, "wireguard"),
        (proto == 50, 0.7, "ipsec-esp"),
        (proto == 51, 0.7, "ipsec-ah"),
        (udp & dport.isin(500, 4500), 0.4, "ipsec-ike"),
        (udp & (dport == 1701), 0.4, "l2tp"),
    ]
    vpn, kind = F.lit(0.0), F.lit("")
    for cond, w, name in signs:
        vpn, kind = vpn + weight(cond, w), F.when(cond, F.lit(name)).otherwise(kind)
    vpn = vpn + weight(c("f_large") / n > 0.5, 0.2)
    nf, nb = c("f_nf"), n - c("f_nf")
    small = (n <= 15) & (nf >= 2) & (nb >= 2) & (F.abs(nf - nb) <= 3) & (c("f_ask_max") <= 600) & (c("f_ask") <= 2000) & (c("f_reply") <= 5000)
    answer = c("f_reply") / F.when(c("f_ask") > 0, c("f_ask"))
    duration = (c("f_end") - c("f_start")) / 1e6
    signs_doh = weight((answer > 0.5) & (answer < 10), 0.15) + weight(duration < 0.5, 0.15) + weight((nf <= 6) & (nb <= 6), 0.1)
    doh = F.when((proto == 6) & (dport == 443) & small, signs_doh).otherwise(F.lit(0.0))
    is_tor, is_vpn, is_doh = tor >= 0.5, vpn >= 0.4, doh >= 0.35
    return {
        "likely_tor": is_tor,
        "tor_confidence": F.least(F.lit(1.0), tor),
        "likely_vpn": is_vpn,
        "vpn_confidence": F.least(F.lit(1.0), vpn),
        "vpn_type": kind,
        "likely_doh": is_doh,
        "doh_confidence": F.least(F.lit(1.0), doh),
        "traffic_type": F.when(is_tor, F.lit("tor")).when(is_vpn, F.when(kind != "", F.concat(F.lit("vpn:"), kind)).otherwise(F.lit("vpn"))).when(is_doh, F.lit("doh")).otherwise(F.lit("encrypted")),
    }


GROUPS = (
    Group("flow_meta", "core", meta_aggregate, meta_finish, optional=("flow_id",)),
    Group("timing", "core", timing_aggregate, timing_finish, timing_prepare, optional=("iat_sequence", "timestamp_sequence", "splt", "splt_lengths", "splt_times", "splt_directions")),
    Group("size", "core", size_aggregate, size_finish, size_prepare, optional=("pkt_len_sequence",)),
    Group("padding", "experimental", padding_aggregate, padding_finish, padding_prepare, needs=("timing", "size")),
    Group("fingerprint", "experimental", fingerprint_aggregate, fingerprint_finish),
)
