"""The same answers in DuckDB SQL, written apart from the Spark plans: sessions first, then a list of expressions for each query."""

from __future__ import annotations

from ..sources.adapters import event_packets_sql

TIMEOUT_US = 21_600_000_000
BURST_US = 50_000
SAMPLE_BYTES = 256

#: Sessions: the row-by-row rule, unrolled into anchors, as common table expressions over ``events``.
SESSIONS = f"""
packets AS ({event_packets_sql('events', 'epoch_us(ts)')}),
keyed AS (
    SELECT *, CASE WHEN turned THEN dst_ip ELSE src_ip END AS ip_a, CASE WHEN turned THEN dst_port ELSE src_port END AS port_a,
        CASE WHEN turned THEN src_ip ELSE dst_ip END AS ip_b, CASE WHEN turned THEN src_port ELSE dst_port END AS port_b,
        coalesce(tcp_flags & 5, 0) <> 0 AS ends
    FROM (SELECT *, (src_ip > dst_ip OR (src_ip = dst_ip AND src_port > dst_port)) AS turned FROM packets)
),
stepped AS (
    SELECT *, row_number() OVER k AS r, coalesce(ts_us - lag(ts_us) OVER k > {TIMEOUT_US}, true) AS gap, coalesce(lag(ends) OVER k, false) AS ended
    FROM keyed WINDOW k AS (PARTITION BY ip_a, port_a, ip_b, port_b, protocol ORDER BY ord)
),
anchored AS (
    SELECT *, max(CASE WHEN gap OR NOT ended THEN r END) OVER k AS a, max(CASE WHEN gap OR NOT ended THEN r * 2 + CAST(gap AS INT) END) OVER k AS ag
    FROM stepped WINDOW k AS (PARTITION BY ip_a, port_a, ip_b, port_b, protocol ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
numbered AS (
    SELECT *, sum(CASE WHEN (r - a) % 2 = ag % 2 THEN 0 ELSE 1 END) OVER k AS session_no
    FROM anchored WINDOW k AS (PARTITION BY ip_a, port_a, ip_b, port_b, protocol ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
directed AS (
    SELECT *, row_number() OVER w AS pos, src_ip = first_value(src_ip) OVER w AND src_port = first_value(src_port) OVER w AS fwd, ts_us - lag(ts_us) OVER w AS iat
    FROM numbered WINDOW w AS (PARTITION BY ip_a, port_a, ip_b, port_b, protocol, session_no ORDER BY ord)
),
s AS (
    SELECT *, CASE WHEN fwd THEN ts_us - lag(ts_us) OVER d END AS iat_f, CASE WHEN NOT fwd THEN ts_us - lag(ts_us) OVER d END AS iat_b,
        pos - max(CASE WHEN iat IS NULL OR iat >= {BURST_US} THEN pos END) OVER (PARTITION BY ip_a, port_a, ip_b, port_b, protocol, session_no ORDER BY ord) + 1 AS burst_place,
        count(*) OVER z AS size_n, min(pos) OVER z AS size_first,
        CASE WHEN tcp_window IS NOT NULL THEN tcp_window - lag(tcp_window) OVER d END AS win_step,
        CASE WHEN tcp_ack IS NOT NULL THEN last_value(tcp_ack IGNORE NULLS) OVER (PARTITION BY ip_a, port_a, ip_b, port_b, protocol, session_no, fwd ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS ack_was,
        CASE WHEN payload_len > 0 THEN count(*) FILTER (payload_len > 0) OVER (PARTITION BY ip_a, port_a, ip_b, port_b, protocol, session_no, fwd, tcp_seq ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) ELSE 0 END AS sent_before,
        (ip_id - lag(ip_id) OVER w + 65536) % 65536 AS id_step
    FROM directed
    WINDOW w AS (PARTITION BY ip_a, port_a, ip_b, port_b, protocol, session_no ORDER BY ord), d AS (PARTITION BY ip_a, port_a, ip_b, port_b, protocol, session_no, fwd ORDER BY ord),
        z AS (PARTITION BY ip_a, port_a, ip_b, port_b, protocol, session_no, total_len)
)"""

KEYS = "ip_a, port_a, ip_b, port_b, protocol, session_no"
SHOWN_KEYS = "ip_a, CAST(port_a AS BIGINT) AS port_a, ip_b, CAST(port_b AS BIGINT) AS port_b, CAST(protocol AS BIGINT) AS protocol, CAST(session_no AS BIGINT) AS session_no"

F_, B_ = "FILTER (fwd)", "FILTER (NOT fwd)"


def _has(mask: int) -> str:
    return f"(tcp_flags & {mask}) <> 0"


def _mean(x: str, f: str = "") -> str:
    return f"coalesce(avg({x}) {f} / 1e6, 0)"


def _std(x: str, f: str = "") -> str:
    return f"coalesce(stddev_pop({x}) {f} / 1e6, 0)"


def _pct(x: str, q: float, f: str = "") -> str:
    return f"coalesce(quantile_cont({x}, {q}) {f}, 0)"


def _ever(cond: str) -> str:
    return f"coalesce(bool_or({cond}), false)"


#: For each query: feature, kind (i whole, b truth, s text, fN rounded to N places, uN seconds shown in microseconds to N places), SQL over one session's rows.
FEATURES: dict[str, list[tuple[str, str, str]]] = {
    "flow_sessions": [
        ("src_ip", "s", "arg_min(src_ip, pos)"),
        ("dst_ip", "s", "arg_min(dst_ip, pos)"),
        ("src_port", "i", "arg_min(src_port, pos)"),
        ("dst_port", "i", "arg_min(dst_port, pos)"),
        ("total_packets", "i", "count(*)"),
        ("packets_fwd", "i", f"count(*) {F_}"),
        ("packets_bwd", "i", f"count(*) {B_}"),
        ("start_time", "u0", "arg_min(ts_us, pos)"),
        ("duration", "u0", "arg_max(ts_us, pos) - arg_min(ts_us, pos)"),
    ],
    "flow_meta_rates": [
        ("total_bytes", "i", "sum(total_len)"),
        ("bytes_fwd", "i", f"coalesce(sum(total_len) {F_}, 0)"),
        ("bytes_bwd", "i", f"coalesce(sum(total_len) {B_}, 0)"),
        ("payload_bytes_total", "i", "sum(payload_len)"),
        ("packets_ratio", "f6", f"count(*) {F_} / greatest(count(*) {B_}, 1)"),
        ("bytes_ratio", "f6", f"CASE WHEN coalesce(sum(total_len) {B_}, 0) > 0 THEN sum(total_len) {F_} / sum(total_len) {B_} ELSE sum(total_len) {F_} END"),
        ("packets_per_second", "f6", "CASE WHEN arg_max(ts_us, pos) > arg_min(ts_us, pos) THEN count(*) / ((arg_max(ts_us, pos) - arg_min(ts_us, pos)) / 1e6) ELSE count(*) END"),
        ("avg_packet_size", "f6", "sum(total_len) / count(*)"),
        (
            "flow_stat",
            "i",
            f"CAST({_ever(_has(2) + ' AND NOT ' + _has(16))} AS INT) + 2 * CAST({_ever(_has(2) + ' AND ' + _has(16))} AS INT) + 4 * CAST({_ever(_has(1) + ' AND fwd')} AS INT)"
            f" + 8 * CAST({_ever(_has(1) + ' AND NOT fwd')} AS INT) + 16 * CAST({_ever(_has(4))} AS INT) + 64 * CAST({_ever(_has(2) + ' AND NOT ' + _has(16))} AND {_ever(_has(2) + ' AND ' + _has(16))}"
            f" AND (({_ever(_has(1) + ' AND fwd')} AND {_ever(_has(1) + ' AND NOT fwd')}) OR {_ever(_has(4))}) AS INT)",
        ),
        ("hdr_desc", "s", "CASE WHEN coalesce(arg_min_null(src_mac, pos), '') <> '' THEN 'ETH-' ELSE '' END || CASE WHEN arg_min(ip_version, pos) = 6 THEN 'IP6-' ELSE 'IP-' END || CASE protocol WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'ICMP' END"),
    ],
    "timing_iat_all": [
        ("iat_min", "u2", "coalesce(min(iat), 0)"),
        ("iat_max", "u2", "coalesce(max(iat), 0)"),
        ("iat_mean", "f3", _mean("iat")),
        ("iat_std", "f3", _std("iat")),
        ("iat_median", "u2", _pct("iat", 0.5)),
        ("iat_p25", "u2", _pct("iat", 0.25)),
        ("iat_p75", "u2", _pct("iat", 0.75)),
        ("iat_p90", "u2", _pct("iat", 0.9)),
        ("iat_p99", "u2", _pct("iat", 0.99)),
    ],
    "timing_iat_dir": [
        *((f"iat_{d}_{n}", "u2", f"coalesce({n}(iat_{d[0]}), 0)") for d in ("fwd", "bwd") for n in ("min", "max")),
        *((f"iat_{d}_mean", "f3", _mean(f"iat_{d[0]}")) for d in ("fwd", "bwd")),
        *((f"iat_{d}_std", "f3", _std(f"iat_{d[0]}")) for d in ("fwd", "bwd")),
        *((f"iat_{d}_median", "u2", _pct(f"iat_{d[0]}", 0.5)) for d in ("fwd", "bwd")),
        ("burstiness_index", "f3", "CASE WHEN coalesce(avg(iat), 0) <> 0 THEN stddev_pop(iat) / avg(iat) ELSE 0 END"),
    ],
    "timing_bursts": [
        ("burst_count", "i", f"CASE WHEN count(*) > 1 THEN count(*) FILTER (iat >= {BURST_US}) + 1 ELSE 0 END"),
        ("avg_burst_packets", "f6", f"CASE WHEN count(*) > 1 THEN count(*) / (count(*) FILTER (iat >= {BURST_US}) + 1) ELSE 0 END"),
        ("max_burst_packets", "i", "CASE WHEN count(*) > 1 THEN max(burst_place) ELSE 0 END"),
        ("idle_count", "i", f"count(*) FILTER (iat >= {BURST_US})"),
        ("avg_idle_duration", "f3", f"coalesce(avg(iat) FILTER (iat >= {BURST_US}) / 1e6, 0)"),
        ("max_idle_duration", "u0", f"coalesce(max(iat) FILTER (iat >= {BURST_US}), 0)"),
        ("first_response_time", "u0", f"coalesce(arg_min(ts_us, pos) {B_} - arg_min(ts_us, pos), 0)"),
    ],
    "size_stats": [
        *((f"pkt_len_{n}", "f6", f"{n}(total_len)") for n in ("min", "max")),
        ("pkt_len_mean", "f6", "avg(total_len)"),
        ("pkt_len_std", "f3", "stddev_pop(total_len)"),
        ("pkt_len_median", "f6", "quantile_cont(total_len, 0.5)"),
        ("pkt_len_p25", "f6", "quantile_cont(total_len, 0.25)"),
        ("pkt_len_p90", "f6", "quantile_cont(total_len, 0.9)"),
        ("pkt_len_fwd_mean", "f6", f"coalesce(avg(total_len) {F_}, 0)"),
        ("pkt_len_bwd_median", "f6", f"coalesce(quantile_cont(total_len, 0.5) {B_}, 0)"),
        ("payload_len_mean", "f6", "avg(payload_len)"),
        ("payload_len_fwd_std", "f3", f"coalesce(stddev_pop(payload_len) {F_}, 0)"),
        ("header_only_ratio", "f6", "count(*) FILTER (payload_len <= 0) / count(*)"),
        ("packets_with_payload", "i", "count(*) FILTER (payload_len > 0)"),
    ],
    "size_l7": [
        ("l7_bytes_total", "i", "sum(payload_len)"),
        ("l7_bytes_fwd", "i", f"coalesce(sum(payload_len) {F_}, 0)"),
        ("l7_pkt_min_fwd", "i", "coalesce(min(payload_len) FILTER (fwd AND payload_len > 0), 0)"),
        ("l7_pkt_max_fwd", "i", "coalesce(max(payload_len) FILTER (fwd AND payload_len > 0), 0)"),
        ("l7_pkt_min_bwd", "i", "coalesce(min(payload_len) FILTER (NOT fwd AND payload_len > 0), 0)"),
        ("l7_pkt_max_bwd", "i", "coalesce(max(payload_len) FILTER (NOT fwd AND payload_len > 0), 0)"),
        ("pkt_asymmetry", "f6", f"(count(*) {F_} - count(*) {B_}) / count(*)"),
        ("byte_asymmetry", "f6", f"CASE WHEN sum(total_len) > 0 THEN (coalesce(sum(total_len) {F_}, 0) - coalesce(sum(total_len) {B_}, 0)) / sum(total_len) ELSE 0 END"),
    ],
    "size_dominant": [
        ("dominant_pkt_size", "i", "arg_max(total_len, {'c': size_n, 'f': -size_first})"),
        ("dominant_pkt_ratio", "f6", "max(size_n) / count(*)"),
    ],
    "tcp_flag_counts": [
        ("tcp_is_tcp", "b", "protocol = 6"),
        *((f"tcp_{n}_count", "i", f"CASE WHEN protocol = 6 THEN count(*) FILTER ({_has(m)}) ELSE 0 END") for n, m in (("fin", 1), ("rst", 4), ("ack", 16), ("psh", 8))),
        ("tcp_syn_count", "i", f"CASE WHEN protocol = 6 THEN count(*) FILTER ({_has(2)} AND NOT {_has(16)}) ELSE 0 END"),
        ("tcp_synack_count", "i", f"CASE WHEN protocol = 6 THEN count(*) FILTER ({_has(2)} AND {_has(16)}) ELSE 0 END"),
        ("tcp_flags_agg", "i", "CASE WHEN protocol = 6 THEN bit_or(tcp_flags) ELSE 0 END"),
        ("tcp_flags_bwd", "i", f"CASE WHEN protocol = 6 THEN coalesce(bit_or(tcp_flags) {B_}, 0) ELSE 0 END"),
        ("tcp_data_packets", "i", "CASE WHEN protocol = 6 THEN count(*) FILTER (payload_len > 0) ELSE 0 END"),
        ("tcp_psh_ratio", "f6", f"CASE WHEN protocol = 6 THEN count(*) FILTER ({_has(8)}) / count(*) ELSE 0 END"),
    ],
    "tcp_state": [
        ("tcp_complete_handshake", "b", f"protocol = 6 AND {_ever(_has(2) + ' AND NOT ' + _has(16) + ' AND fwd')} AND {_ever(_has(2) + ' AND ' + _has(16) + ' AND NOT fwd')}"),
        ("tcp_graceful_close", "b", f"protocol = 6 AND {_ever(_has(1) + ' AND fwd')} AND {_ever(_has(1) + ' AND NOT fwd')}"),
        ("tcp_reset_close", "b", f"protocol = 6 AND {_ever(_has(4))}"),
        ("tcp_flags_anomaly", "b", f"protocol = 6 AND {_ever('tcp_flags = 0 OR (tcp_flags & 41) = 41 OR (tcp_flags & 19) = 1 OR (tcp_flags & 3) = 3 OR (tcp_flags & 6) = 6')}"),
        ("tcp_ack_only_packets", "i", "CASE WHEN protocol = 6 THEN count(*) FILTER ((tcp_flags & 16) <> 0 AND payload_len = 0 AND (tcp_flags & 7) = 0) ELSE 0 END"),
    ],
    "padding_scores": [
        ("pkt_size_cv", "f6", "CASE WHEN avg(total_len) > 0 THEN stddev_pop(total_len) / avg(total_len) ELSE 0 END"),
        ("unique_size_count", "i", "count(DISTINCT total_len)"),
        ("size_entropy", "f6", "CASE WHEN count(DISTINCT total_len) > 1 THEN (log2(count(*)) - avg(log2(size_n))) / log2(count(DISTINCT total_len)) ELSE 0 END"),
        ("is_constant_size", "b", "max(size_n) / count(*) >= 0.95"),
        ("is_constant_rate", "b", "count(*) > 1 AND CASE WHEN avg(iat) > 0 THEN stddev_pop(iat) / avg(iat) ELSE 0 END <= 0.1"),
        ("tor_cell_count", "i", "count(*) FILTER (total_len BETWEEN 580 AND 600)"),
        ("burst_overhead_bytes", "i", "CASE WHEN count(*) > 1 THEN sum(total_len - payload_len) ELSE 0 END"),
    ],
    "fingerprint_vpn_tor": [
        ("tor_confidence", "f6", "(CASE WHEN count(*) FILTER (total_len BETWEEN 580 AND 600) / count(*) > 0.7 THEN 0.4 ELSE 0 END) + (CASE WHEN CASE WHEN avg(total_len) > 0 THEN stddev_pop(total_len) / avg(total_len) ELSE 1 END < 0.1 THEN 0.3 ELSE 0 END) + (CASE WHEN arg_min(dst_port, pos) IN (443, 9001, 9030, 9050, 9051) THEN 0.1 ELSE 0 END)"),
        ("vpn_confidence", "f6", "CASE WHEN count(*) FILTER (total_len BETWEEN 1400 AND 1500) / count(*) > 0.5 THEN 0.2 ELSE 0 END"),
        ("likely_vpn", "b", "false"),
        ("vpn_type", "s", "''"),
    ],
    "window_changes": [
        *((f"tcp_win_{d}_{n}", "i", f"coalesce({n}(tcp_window) {f}, 0)") for d, f in (("fwd", F_), ("bwd", B_)) for n in ("min", "max")),
        *((f"tcp_win_{d}_up_count", "i", f"count(*) FILTER ({g} AND win_step > 0)") for d, g in (("fwd", "fwd"), ("bwd", "NOT fwd"))),
        *((f"tcp_win_{d}_down_count", "i", f"count(*) FILTER ({g} AND win_step < 0)") for d, g in (("fwd", "fwd"), ("bwd", "NOT fwd"))),
        ("tcp_init_win_fwd", "i", f"coalesce(arg_min(tcp_window, pos) {F_}, 0)"),
        ("tcp_zero_win_ratio", "f6", "count(*) FILTER (tcp_window = 0) / count(*)"),
    ],
    "tcp_option_facts": [
        *((f"tcp_mss_{d}", "i", f"coalesce(arg_min(tcp_mss, pos) FILTER ({g} AND tcp_mss IS NOT NULL), 0)") for d, g in (("fwd", "fwd"), ("bwd", "NOT fwd"))),
        *((f"tcp_ws_{d}", "i", f"coalesce(arg_min(tcp_window_scale, pos) FILTER ({g} AND tcp_window_scale IS NOT NULL), 0)") for d, g in (("fwd", "fwd"), ("bwd", "NOT fwd"))),
        *((f"tcp_sack_permitted_{d}", "i", f"CAST({_ever('tcp_sack_permitted AND ' + g)} AS INT)") for d, g in (("fwd", "fwd"), ("bwd", "NOT fwd"))),
        ("tcp_options_bitmap", "i", f"CAST({_ever('tcp_mss IS NOT NULL')} AS INT) + 2 * CAST({_ever('tcp_window_scale IS NOT NULL')} AS INT) + 4 * CAST({_ever('tcp_sack_permitted')} AS INT)"),
    ],
    "dup_ack": [
        *((f"tcp_ack_{d}_count", "i", f"count(tcp_ack) {f}") for d, f in (("fwd", F_), ("bwd", B_))),
        *((f"tcp_ack_{d}_dup", "i", f"count(*) FILTER ({g} AND tcp_ack = ack_was)") for d, g in (("fwd", "fwd"), ("bwd", "NOT fwd"))),
        *((f"tcp_isn_{d}", "i", f"coalesce(arg_min(tcp_seq, pos) {f}, 0)") for d, f in (("fwd", F_), ("bwd", B_))),
        *((f"tcp_seq_{d}_retrans", "i", f"count(*) FILTER ({g} AND sent_before > 0)") for d, g in (("fwd", "fwd"), ("bwd", "NOT fwd"))),
        *((f"tcp_seq_{d}_bytes_sent", "i", f"coalesce(sum(payload_len) FILTER ({g} AND sent_before = 0), 0)") for d, g in (("fwd", "fwd"), ("bwd", "NOT fwd"))),
    ],
    "ip_facts": [
        *((f"ip_ttl_{d}_{n}", "i", f"coalesce({n}(ip_ttl) {f}, 0)") for d, f in (("fwd", F_), ("bwd", B_)) for n in ("min", "max")),
        ("ip_ttl_fwd_mean", "f6", f"coalesce(avg(ip_ttl) {F_}, 0)"),
        ("ip_ttl_fwd_changes", "i", f"greatest(count(DISTINCT ip_ttl) {F_} - 1, 0)"),
        ("ip_ttl_fwd_hops_est", "i", "(CASE WHEN arg_min(ip_ttl, pos) <= 64 THEN 64 WHEN arg_min(ip_ttl, pos) <= 128 THEN 128 ELSE 255 END) - arg_min(ip_ttl, pos)"),
        ("ip_dscp", "i", "min(ip_tos) >> 2"),
        ("ip_ecn", "i", "min(ip_tos) & 3"),
        ("ip_flags", "i", "bit_or(ip_flags)"),
        ("ip_df_count", "i", "count(*) FILTER ((ip_flags & 2) <> 0)"),
        ("ip_id_gaps", "i", "count(*) FILTER (id_step > 1)"),
        ("ip_version", "i", "min(ip_version)"),
    ],
    "ipv6_facts": [
        ("ipv6_packet_count", "i", "count(*) FILTER (ip_version = 6)"),
        ("ipv6_flow_label", "i", "coalesce(min(ipv6_flow_label), 0)"),
        ("ipv6_flow_label_unique_count", "i", "count(DISTINCT ipv6_flow_label)"),
        ("ipv6_traffic_class_unique_count", "i", "count(DISTINCT ipv6_traffic_class)"),
        ("ipv6_dscp", "i", "coalesce(min(ipv6_traffic_class), 0) >> 2"),
        ("ipv6_ratio", "f6", "count(*) FILTER (ip_version = 6) / count(*)"),
        ("is_ipv6_only", "i", "CAST(count(*) FILTER (ip_version = 6) = count(*) AS INT)"),
    ],
    "icmp_facts": [
        ("icmp_packet_count", "i", "count(icmp_type)"),
        ("icmp_echo_request_count", "i", "count(*) FILTER (icmp_type = 8)"),
        ("icmp_unique_type_codes", "i", "count(DISTINCT icmp_type * 1000 + icmp_code)"),
        ("icmp_unique_ids", "i", "count(DISTINCT icmp_id)"),
        ("icmp_seq_min", "i", "coalesce(min(icmp_seq), 0)"),
        ("icmp_stat", "i", f"CAST({_ever('icmp_type = 8')} AS INT) + 2 * CAST({_ever('icmp_type = 0')} AS INT)"),
        ("icmp_echo_success_ratio", "f6", "CASE WHEN count(*) FILTER (icmp_type = 8) > 0 THEN count(*) FILTER (icmp_type = 0) / count(*) FILTER (icmp_type = 8) ELSE 0 END"),
    ],
    "mac_facts": [
        ("mac_src", "s", "coalesce(arg_min_null(src_mac, pos), '')"),
        ("mac_vlan_id", "i", "coalesce(min(vlan_id), 0)"),
        ("mac_vlan_count", "i", "count(DISTINCT vlan_id)"),
        ("mac_unique_src_count", "i", "count(DISTINCT src_mac)"),
        ("mac_unique_dst_count", "i", "count(DISTINCT dst_mac)"),
        ("mac_broadcast_count", "i", "count(*) FILTER (dst_mac = 'ff:ff:ff:ff:ff:ff')"),
        ("mac_multicast_count", "i", "count(*) FILTER (dst_mac LIKE '01:%' OR dst_mac LIKE 'bb:%')"),
    ],
    "syn_fingerprint": [
        *((f"tcp_fp_{d}_window", "i", f"coalesce(arg_min(tcp_window, pos) FILTER ({g}), 0)") for d, g in (("fwd", f"fwd AND {_has(2)} AND NOT {_has(16)}"), ("bwd", f"NOT fwd AND {_has(2)} AND {_has(16)}"))),
        ("tcp_fp_fwd_ttl", "i", f"coalesce(arg_min(ip_ttl, pos) FILTER (fwd AND {_has(2)} AND NOT {_has(16)}), 0)"),
        (
            "tcp_fp_fwd",
            "s",
            f"coalesce(arg_min('t' || tcp_window || '_' || coalesce(tcp_mss, 0) || '_' || coalesce(tcp_window_scale, 0) || '_' || substr(md5(tcp_window || '_' || ip_ttl || '_' || coalesce(tcp_mss, 0) || '_' || coalesce(tcp_window_scale, 0) || '_' || CAST(tcp_sack_permitted AS INT)), 1, 12), pos) FILTER (fwd AND {_has(2)} AND NOT {_has(16)}), '')",
        ),
    ],
    "hash_anonymise": [
        ("flow_id", "s", "substr(sha256('pepper' || ip_a || ':' || port_a || ':' || ip_b || ':' || port_b || ':' || protocol), 1, 32)"),
        ("src_ip", "s", "substr(sha256('pepper' || arg_min(src_ip, pos)), 1, 16)"),
        ("dst_ip", "s", "substr(sha256('pepper' || arg_min(dst_ip, pos)), 1, 16)"),
    ],
    "port_class": [
        ("dst_port_class", "s", "CASE arg_min(dst_port, pos) WHEN 443 THEN 'https' WHEN 80 THEN 'http' WHEN 53 THEN 'dns' ELSE 'registered' END"),
        ("dst_port_class_num", "i", "CASE WHEN arg_min(dst_port, pos) < 1024 THEN 1 ELSE 2 END"),
    ],
}


def expression(kind: str, sql: str) -> str:
    if kind == "i":
        return f"CAST({sql} AS BIGINT)"
    if kind[0] in "fu":
        return f"round(CAST({sql} AS DOUBLE), {kind[1:]})"
    return f"({sql})"


def session_query(name: str) -> str:
    columns = ",\n    ".join(f"{expression(kind, sql)} AS {feature}" for feature, kind, sql in FEATURES[name])
    return f"WITH {SESSIONS}\nSELECT {SHOWN_KEYS},\n    {columns}\nFROM s GROUP BY {KEYS}"


OTHERS: dict[str, str] = {}

OTHERS["splt_exploded"] = f"""WITH {SESSIONS}
SELECT {SHOWN_KEYS}, CAST(pos AS BIGINT) AS pos, CAST(total_len AS BIGINT) AS len, CAST(coalesce(iat, 0) AS BIGINT) AS iat_us, CAST(CASE WHEN fwd THEN 1 ELSE -1 END AS BIGINT) AS dir FROM s WHERE pos <= 50"""

OTHERS["protocol_histogram"] = f"""WITH {SESSIONS}
SELECT CAST(protocol AS BIGINT) AS protocol, count(*) AS packets, CAST(sum(total_len) AS BIGINT) AS bytes, round(count(*) / (SELECT count(*) FROM s), 6) AS share FROM s GROUP BY protocol"""

OTHERS["rtt_asof"] = f"""WITH {SESSIONS},
sent AS (SELECT {KEYS}, fwd, ord, ts_us, (tcp_seq + payload_len) % 4294967296 AS number FROM s WHERE payload_len > 0),
acks AS (SELECT {KEYS}, NOT fwd AS fwd, ord, ts_us, tcp_ack AS number FROM s WHERE tcp_ack IS NOT NULL),
met AS (
    SELECT {', '.join('a.' + k for k in KEYS.split(', '))}, a.fwd, a.number, a.ord, max(d.ord) AS d_ord, arg_max(d.ts_us, d.ord) AS d_ts, min(a.ts_us) AS a_ts
    FROM acks a JOIN sent d ON {' AND '.join(f'a.{k} = d.{k}' for k in KEYS.split(', '))} AND a.fwd = d.fwd AND a.number = d.number AND d.ord < a.ord
    GROUP BY ALL
),
firsts AS (SELECT {KEYS}, fwd, number, d_ord, arg_min(a_ts, ord) - min(d_ts) AS rtt FROM met GROUP BY {KEYS}, fwd, number, d_ord),
kept AS (SELECT {KEYS}, min(rtt) AS lo, max(rtt) AS hi, avg(rtt) AS mean FROM firsts WHERE rtt > 0 AND rtt < 60000000 GROUP BY {KEYS}),
every AS (SELECT DISTINCT {KEYS} FROM s)
SELECT {SHOWN_KEYS}, round(CAST(coalesce(lo, 0) AS DOUBLE), 0) AS tcp_rtt_ack_min, round(CAST(coalesce(hi, 0) AS DOUBLE), 0) AS tcp_rtt_ack_max, round(coalesce(mean / 1e6, 0), 3) AS tcp_rtt_ack_mean
FROM every LEFT JOIN kept USING ({KEYS})"""

TRADE = """trade AS (
    SELECT cn.n_name AS src, sn.n_name AS dst, 1024 + l_linenumber AS port, l_extendedprice AS price, CAST(epoch_us(o_orderdate) AS BIGINT) AS us
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey
)"""

OTHERS["conn_basic"] = f"""WITH {TRADE}, edges AS (SELECT src, dst, count(*) AS n FROM trade GROUP BY src, dst),
outs AS (SELECT src, count(*) AS flows, count(DISTINCT dst) AS nodes, count(DISTINCT port) AS ports, sum(CAST(round(price) AS BIGINT)) AS bytes FROM trade GROUP BY src),
ins AS (SELECT dst, count(*) AS flows, count(DISTINCT src) AS nodes, sum(CAST(round(price) AS BIGINT)) AS bytes FROM trade GROUP BY dst)
SELECT src, dst, CAST(e.n AS BIGINT) AS conn_src_dst_flows, CAST(o.nodes AS BIGINT) AS conn_src_unique_dsts, CAST(i.nodes AS BIGINT) AS conn_dst_unique_srcs, CAST(o.flows AS BIGINT) AS conn_src_total_flows,
    CAST(i.flows AS BIGINT) AS conn_dst_total_flows, CAST(o.bytes AS BIGINT) AS conn_src_total_bytes, CAST(i.bytes AS BIGINT) AS conn_dst_total_bytes, CAST(o.ports AS BIGINT) AS conn_src_unique_ports
FROM edges e JOIN outs o USING (src) JOIN ins i USING (dst)"""

OTHERS["conn_clustering"] = """WITH few AS (SELECT DISTINCT CAST(a.o_custkey AS VARCHAR) AS src, CAST(b.o_custkey AS VARCHAR) AS dst FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_custkey <> b.o_custkey),
und AS (SELECT src AS a, dst AS b FROM few UNION SELECT dst, src FROM few),
deg AS (SELECT a, count(*) AS k FROM und GROUP BY a),
tri AS (SELECT x.a, count(*) AS t FROM und x JOIN und y ON x.b = y.a JOIN und z ON y.b = z.b AND z.a = x.a WHERE x.b <> y.b GROUP BY x.a)
SELECT a AS node, round(CASE WHEN k > 1 THEN coalesce(t, 0) / (k * (k - 1)) ELSE 0 END, 6) AS clustering FROM deg LEFT JOIN tri USING (a)"""

OTHERS["conn_temporal"] = f"""WITH {TRADE}, roles AS (SELECT src AS node, us, 1 AS o FROM trade UNION ALL SELECT dst, us, 0 FROM trade),
runs AS (SELECT node, us, o, sum(CASE WHEN us - p <= 1000000 THEN 0 ELSE 1 END) OVER (PARTITION BY node ORDER BY us, rn) AS run FROM (SELECT *, lag(us) OVER (PARTITION BY node ORDER BY us) AS p, row_number() OVER (PARTITION BY node ORDER BY us) AS rn FROM roles)),
most AS (SELECT node, max(n) AS burst FROM (SELECT node, run, count(*) AS n FROM runs GROUP BY node, run) GROUP BY node)
SELECT node, round(sum(o) / ((max(us) - min(us)) / 1e6), 9) AS rate, round(stddev_pop(us / 1e6), 0) AS spread, CAST(any_value(burst) AS BIGINT) AS burst FROM roles JOIN most USING (node) GROUP BY node"""

OTHERS["label_join"] = """SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), 'unknown') AS label FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)"""

OTHERS["label_counts"] = """SELECT CAST(quality AS VARCHAR) AS label, count(*) AS n FROM labels GROUP BY quality"""

OTHERS["entropy_text"] = """WITH b AS (SELECT item_id, substr(hex(encode(text)), 2 * i + 1, 2) AS h FROM (SELECT item_id, text, unnest(range(strlen(text))) AS i FROM benchmark)),
c AS (SELECT item_id, h, count(*) AS n FROM b GROUP BY item_id, h)
SELECT item_id, CAST(sum(n) AS BIGINT) AS n, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy,
    CAST(coalesce(sum(n) FILTER ((h >= '20' AND h <= '7E') OR h IN ('09', '0A', '0D')), 0) AS BIGINT) AS printable, CAST(coalesce(sum(n) FILTER (h >= '80'), 0) AS BIGINT) AS high
FROM c GROUP BY item_id"""

OTHERS["ja3_strings"] = """WITH v AS (SELECT page_id, 769 + page_id % 3 AS version, [4865 + (page_id * k) % 50 FOR k IN range(1, 6)] AS c, [(page_id * k * 2570) % 65536 FOR k IN range(1, 5)] AS e, [23 + k FOR k IN range(page_id % 4)] AS g FROM pages)
SELECT page_id, version || ',' || array_to_string(c, '-') || ',' || array_to_string(list_filter(e, lambda x: (x & 3855) <> 2570), '-') || ',' || array_to_string(g, '-') || ',0' AS ja3,
    md5(version || ',' || array_to_string(c, '-') || ',' || array_to_string(list_filter(e, lambda x: (x & 3855) <> 2570), '-') || ',' || array_to_string(g, '-') || ',0') AS ja3_hash FROM v"""

OTHERS["profile_projection"] = session_query("size_dominant")

OTHERS["bidir_split"] = f"""WITH {SESSIONS}
SELECT {SHOWN_KEYS}, CAST(sum(total_len) AS BIGINT) AS total_total_bytes, CAST(coalesce(sum(total_len) {F_}, 0) AS BIGINT) AS bytes_fwd FROM s GROUP BY {KEYS}"""

OTHERS["conversation_directions"] = """SELECT CAST(conv_id AS VARCHAR) AS file_id, count(*) AS total_packets, CAST(sum(strlen(text) + 40) AS BIGINT) AS total_bytes, round(stddev_pop(strlen(text)), 3) AS payload_len_std
FROM conversations GROUP BY conv_id"""

#: Numbers of these streams stay far under the wrap, so the next expected one is the greatest end so far.
OTHERS["seq_fold"] = f"""WITH {SESSIONS},
expected AS (SELECT *, max(tcp_seq + greatest(payload_len, 1)) OVER (PARTITION BY {KEYS}, fwd ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS want FROM s)
SELECT {SHOWN_KEYS}, count(*) FILTER (fwd AND tcp_seq > want) AS tcp_seq_fwd_gaps, count(*) FILTER (fwd AND tcp_seq < want) AS tcp_seq_fwd_ooo,
    count(*) FILTER (NOT fwd AND tcp_seq > want) AS tcp_seq_bwd_gaps, count(*) FILTER (NOT fwd AND tcp_seq < want) AS tcp_seq_bwd_ooo
FROM expected GROUP BY {KEYS}"""

OTHERS["entropy_flows"] = f"""WITH turns AS (SELECT *, (role <> 'assistant') = first_value(role <> 'assistant') OVER (PARTITION BY conv_id ORDER BY turn) AS fwd FROM conversations),
sides AS (SELECT conv_id, fwd, left(hex(encode(string_agg(text, '' ORDER BY turn))), {2 * SAMPLE_BYTES}) AS h FROM turns GROUP BY conv_id, fwd),
each AS (SELECT conv_id, fwd, substr(h, 2 * i + 1, 2) AS v FROM (SELECT *, unnest(range(strlen(h) // 2)) AS i FROM sides)),
counted AS (SELECT conv_id, fwd, v, count(*) AS n FROM each GROUP BY conv_id, fwd, v),
said AS (SELECT conv_id, fwd, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS e FROM counted GROUP BY conv_id, fwd),
whole AS (SELECT conv_id, v, CAST(sum(n) AS BIGINT) AS n FROM counted GROUP BY conv_id, v),
facts AS (SELECT conv_id, sum(n) AS total, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS e, sum(n * n) / (sum(n) * sum(n)) - 1 / 256 AS uneven,
    coalesce(sum(n) FILTER ((v >= '20' AND v <= '7E') OR v IN ('09', '0A', '0D')), 0) / sum(n) AS printable, coalesce(sum(n) FILTER (v >= '80'), 0) / sum(n) AS high FROM whole GROUP BY conv_id),
convs AS (SELECT DISTINCT conv_id FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS file_id, round(coalesce(f.e, 0), 6) + 0.0 AS entropy_payload, round(coalesce(i.e, 0), 6) + 0.0 AS entropy_initiator, round(coalesce(r.e, 0), 6) + 0.0 AS entropy_responder,
    round(CAST(coalesce(printable, 0) AS DOUBLE), 6) AS printable_ratio, round(CAST(coalesce(high, 0) AS DOUBLE), 6) AS high_byte_ratio,
    round(CASE WHEN total >= 256 THEN greatest(0, 1 - uneven) ELSE 0 END, 6) AS byte_distribution_uniformity, CAST(coalesce(total, 0) AS BIGINT) AS payload_bytes_sampled
FROM convs LEFT JOIN facts f USING (conv_id) LEFT JOIN (FROM said WHERE fwd) i USING (conv_id) LEFT JOIN (FROM said WHERE NOT fwd) r USING (conv_id)"""

OTHERS["label_sessions"] = f"""WITH {SESSIONS},
flows AS (SELECT arg_min(src_ip, pos) AS src, arg_min(dst_ip, pos) AS dst FROM s GROUP BY {KEYS}),
users AS (SELECT DISTINCT src_ip AS u, dst_ip AS v FROM packets WHERE src_ip LIKE 'u%' AND dst_port = 443)
SELECT label, count(*) AS n FROM (SELECT coalesce('of ' || a.u, 'of ' || b.u, 'unknown') AS label FROM flows f LEFT JOIN users a ON a.u = f.src AND a.v = f.dst LEFT JOIN users b ON b.u = f.dst AND b.v = f.src) GROUP BY label"""


def all_sql() -> dict[str, str]:
    return {name: session_query(name) for name in FEATURES} | OTHERS
