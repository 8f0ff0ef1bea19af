from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from packets import CLIENT, SERVER, frame, packet, tcp_session

from rillstream.config import Config
from rillstream.operators.sessionize import sessionize
from rillstream.plans.extract import GROUPS, extract


def simulate(rows, timeout_us, terminate):
    """Open sessions in a table, a packet at a time: which session a packet falls into, by key and number."""
    open_, numbers, out = {}, defaultdict(int), {}
    for p in sorted(rows, key=lambda p: p["ord"]):
        a, b = (p["src_ip"], p["src_port"]), (p["dst_ip"], p["dst_port"])
        key = (min(a, b), max(a, b), p["protocol"])
        if key in open_ and p["ts_us"] - open_[key] > timeout_us:
            del open_[key]
        fresh = key not in open_
        if fresh:
            numbers[key] += 1
        out[p["ord"]] = numbers[key]
        open_[key] = p["ts_us"]
        if terminate and not fresh and (p["tcp_flags"] or 0) & 5:
            del open_[key]
    return out


ends = [("10.0.0.2", 1), ("9.0.0.1", 2), ("10.0.0.2", 3)]
steps = st.tuples(st.integers(0, 2), st.booleans(), st.integers(0, 90), st.sampled_from([None, 0, 1, 2, 4, 16, 17, 20]))


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(steps, min_size=1, max_size=60), st.booleans())
def test_sessions_equal_a_simulation(spark, moves, terminate):
    rows, us = [], 0
    for k, (pair, turned, wait, flags) in enumerate(moves):
        us += wait * 1_000_000
        a, b = ends[pair], ends[(pair + 1) % 3]
        rows.append(packet(k, us, *((b, a) if turned else (a, b)), flags=flags))
    cfg = Config(flow_timeout=60, terminate_on_fin_rst=terminate)
    got = {r.ord: r.session_no for r in sessionize(frame(spark, rows), cfg).select("ord", "session_no").collect()}
    assert got == simulate(rows, cfg.timeout_us, terminate)


def one(spark, rows, **options):
    return extract(frame(spark, rows), Config(**options)).collect()[0].asDict()


def test_features_of_a_session(spark):
    groups = tuple(g for g in GROUPS)
    r = one(spark, tcp_session(), groups=groups, include_splt=True)
    assert (r["total_packets"], r["packets_fwd"], r["packets_bwd"]) == (8, 5, 3)
    assert (r["total_bytes"], r["payload_bytes_total"], r["duration"]) == (3320, 3000, 1.0)
    assert (r["burst_count"], r["idle_count"], r["max_burst_packets"]) == (2, 1, 7)
    assert r["avg_idle_duration"] == pytest.approx(0.93)
    assert r["iat_mean"] == pytest.approx(1 / 7) and r["iat_median"] == pytest.approx(0.01)
    assert r["tcp_complete_handshake"] and not r["tcp_graceful_close"] and r["tcp_rtt_handshake"] == pytest.approx(0.02)
    assert (r["dominant_pkt_size"], r["dominant_pkt_ratio"]) == (40, 5 / 8)
    assert (r["src_ip"], r["dst_port_class"], r["hdr_desc"], r["flow_stat"]) == (CLIENT[0], "https", "IP-TCP", 1 | 2 | 4)
    assert r["splt_lengths"] == [40, 40, 40, 240, 1440, 1440, 40, 40] and r["splt_directions"] == [1, -1, 1, 1, -1, -1, 1, 1]
    assert not [k for k, v in r.items() if v is None]


def test_a_fin_leaves_the_peers_fin_as_its_own_session(spark):
    rows = tcp_session() + [packet(8, 1_001_100_000, SERVER, CLIENT, flags=17)]
    got = sessionize(frame(spark, rows)).groupBy("session_no", "close_reason", "init_ip").count().collect()
    assert sorted((r.session_no, r.close_reason, r["count"], r.init_ip) for r in got) == [(1, "completed", 8, CLIENT[0]), (2, "flushed", 1, SERVER[0])]


def test_sequence_fold(spark):
    seqs = [(100, 10), (110, 10), (130, 10), (120, 10), (110, 10), (140, 5)]
    rows = [packet(k, k * 1000, payload=n, tcp_seq=s) for k, (s, n) in enumerate(seqs)]
    r = one(spark, rows, groups=("tcp_sequence",))
    assert (r["tcp_seq_fwd_retrans"], r["tcp_seq_fwd_gaps"], r["tcp_seq_fwd_ooo"], r["tcp_seq_fwd_bytes_sent"]) == (1, 1, 2, 45)
    wrap = [packet(0, 0, payload=10, tcp_seq=(1 << 32) - 5), packet(1, 1, payload=10, tcp_seq=5)]
    r = one(spark, wrap, groups=("tcp_sequence",))
    assert (r["tcp_seq_fwd_gaps"], r["tcp_seq_fwd_ooo"]) == (0, 0)


def test_round_trips_by_stamps_and_acknowledgements(spark):
    rows = [
        packet(0, 0, tcp_timestamp=(10, 0), tcp_seq=1, payload=5),
        packet(1, 40_000, SERVER, CLIENT, tcp_timestamp=(77, 10), tcp_seq=9, tcp_ack=6),
        packet(2, 50_000, SERVER, CLIENT, tcp_timestamp=(78, 10), tcp_seq=9, tcp_ack=6),
        packet(3, 90_000, tcp_timestamp=(11, 78), tcp_seq=6),
    ]
    r = one(spark, rows, groups=("tcp_rtt",))
    assert (r["tcp_rtt_samples"], r["tcp_rtt_min"], r["tcp_rtt_max"]) == (3, 0.04, 0.05)
    assert (r["tcp_rtt_ack_min"], r["tcp_rtt_ack_max"]) == (0.04, 0.04)
    assert r["tcp_rtt_jitter_avg"] == pytest.approx(0.01)


def test_empty_stream_and_optional_columns(spark):
    assert extract(frame(spark, []), Config(groups=tuple(GROUPS))).collect() == []
    few = frame(spark, tcp_session()).select("ord", "ts_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "payload_len", "total_len")
    assert extract(few, Config(groups=("flow_meta", "tcp"))).collect()[0]["tcp_syn_count"] == 0


def test_projection_split_and_anonymity(spark):
    rows = tcp_session()
    r = one(spark, rows, groups=("flow_meta",), features=("flow_meta.total_bytes", "duration"))
    assert list(r) == ["duration", "total_bytes"]
    assert "total_total_bytes" in one(spark, rows, groups=("flow_meta",), bidirectional_split=True)
    r = one(spark, rows, groups=("flow_meta",), anonymize_ips=True, anonymization_salt="s", include_ports=False)
    assert len(r["src_ip"]) == 16 and "src_port" not in r
    core = extract(frame(spark, rows), Config(profile="core", groups=("all",))).columns
    assert len(core) == 151
