"""Packets for tests, made row by row."""

from rillstream.schema import packet_type

CLIENT, SERVER = ("192.168.1.100", 54321), ("10.0.0.1", 443)


def packet(ord_, us, src=CLIENT, dst=SERVER, proto=6, payload=0, total=None, flags=16, **more):
    row = {"file_id": "", "ord": ord_, "ts_us": us, "src_ip": src[0], "src_port": src[1], "dst_ip": dst[0], "dst_port": dst[1], "protocol": proto, "payload_len": payload, "total_len": payload + 40 if total is None else total, "tcp_flags": flags}
    return row | more


def tcp_session():
    """Handshake, a request, two answers, an acknowledgement, and a FIN a second after the start."""
    base = 1_000_000_000
    rows = [(0, CLIENT, SERVER, 0, 2), (10, SERVER, CLIENT, 0, 18), (20, CLIENT, SERVER, 0, 16), (30, CLIENT, SERVER, 200, 24), (50, SERVER, CLIENT, 1400, 24), (60, SERVER, CLIENT, 1400, 24), (70, CLIENT, SERVER, 0, 16), (1000, CLIENT, SERVER, 0, 17)]
    return [packet(k, base + ms * 1000, a, b, payload=n, flags=f) for k, (ms, a, b, n, f) in enumerate(rows)]


def frame(spark, rows):
    kind = packet_type()
    return spark.createDataFrame([tuple(r.get(n) for n in kind.names) for r in rows], kind)
