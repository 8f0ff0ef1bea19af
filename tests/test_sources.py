import struct

import pytest
from packets import frame, packet, tcp_session

from rillstream.config import Config
from rillstream.functions import parsers as P
from rillstream.operators import sinks
from rillstream.operators.labels import label_counts, label_sessions, unique_labels
from rillstream.plans.extract import extract
from rillstream.sources.pcap import CaptureSource, frames
from rillstream.sources.pcap import packet as decoded


def ip4(src, dst, proto, body, ttl=64):
    head = struct.pack("!BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 7, 0x4000, ttl, proto, 0, bytes(src), bytes(dst))
    return head + body


def tcp(sport, dport, seq=1, ack=0, flags=2, payload=b"", options=b""):
    options += b"\0" * (-len(options) % 4)
    return struct.pack("!HHIIBBHHH", sport, dport, seq, ack, (20 + len(options)) << 2, flags, 8192, 0, 0) + options + payload


def ether(body, vlan=None):
    head = bytes.fromhex("aabbccddeeff112233445566")
    return head + (b"\x81\x00" + vlan.to_bytes(2, "big") if vlan else b"") + b"\x08\x00" + body


def classic(packets, order="<", nano=False, link=1):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, link)
    for us, data in packets:
        out += struct.pack(order + "IIII", us // 10**6, us % 10**6 * (1000 if nano else 1), len(data), len(data)) + data
    return out


def next_gen(packets, order="<"):
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        size = len(body) + 12
        return struct.pack(order + "II", kind, size) + body + struct.pack(order + "I", size)

    out = block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack(order + "HHI", 1, 0, 0))
    for us, data in packets:
        out += block(6, struct.pack(order + "IIIII", 0, us >> 32, us & 0xFFFFFFFF, len(data), len(data)) + data)
    return out


OPTIONS = bytes.fromhex("020405b4 0101 080a 0000000a 00000014 0402 030307".replace(" ", ""))
FRAME = ether(ip4((10, 0, 0, 1), (10, 0, 0, 2), 6, tcp(1234, 80, options=OPTIONS, payload=b"hello")), vlan=5)


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("make", [classic, next_gen, lambda p, o: classic(p, o, nano=True)])
def test_captures_of_all_kinds(tmp_path, order, make):
    path = tmp_path / "a.pcap"
    path.write_bytes(make([(5_000_001, FRAME), (6_000_002, FRAME[:20])], order))
    got = [decoded(*f) for f in frames(str(path))]
    assert got[1] is None
    p = got[0]
    assert (p["ts_us"], p["src_ip"], p["dst_ip"], p["src_port"], p["dst_port"], p["protocol"]) == (5_000_001, "10.0.0.1", "10.0.0.2", 1234, 80, 6)
    assert (p["vlan_id"], p["src_mac"], p["eth_type"], p["ip_ttl"], p["ip_flags"]) == (5, "11:22:33:44:55:66", 0x800, 64, 2)
    assert (p["tcp_mss"], p["tcp_window_scale"], p["tcp_sack_permitted"], p["tcp_timestamp"]) == (1460, 7, True, (10, 20))
    assert (p["payload_len"], p["raw_payload"], p["total_len"]) == (5, b"hello", 20 + 20 + 24 + 5)


def test_source_reads_a_folder_and_a_stream(spark, tmp_path):
    spark.dataSource.register(CaptureSource)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.pcap").write_bytes(classic([(1, FRAME), (2, FRAME)]))
    (folder / "b.pcapng").write_bytes(next_gen([(3, FRAME)]))
    (folder / "note.txt").write_text("no capture")
    df = spark.read.format("capture").load(str(folder))
    assert sorted((r.file_id, r.ord, r.ts_us) for r in df.collect()) == [("a.pcap", 0, 1), ("a.pcap", 1, 2), ("b.pcapng", 0, 3)]
    r = extract(df, Config(groups=("flow_meta", "tcp_options"))).collect()
    assert sorted(x.total_packets for x in r) == [1, 2] and r[0].tcp_mss_fwd == 1460
    stream = spark.readStream.format("capture").load(str(folder))
    for count in (3, 4):
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(90)
        assert spark.read.parquet(str(tmp_path / "out")).count() == count
        (folder / "c.cap").write_bytes(classic([(4, FRAME)]))


def client_hello(sni=b"example.com"):
    def ext(kind, body):
        return struct.pack("!HH", kind, len(body)) + body

    exts = ext(0, struct.pack("!HBH", len(sni) + 3, 0, len(sni)) + sni) + ext(0x0A0A, b"") + ext(10, struct.pack("!HHH", 4, 29, 23)) + ext(11, b"\x01\x00")
    exts += ext(16, b"\x00\x03\x02h2") + ext(35, b"") + ext(51, struct.pack("!HHH", 36, 29, 32) + b"k" * 32)
    body = struct.pack("!H", 0x0303) + b"r" * 32 + b"\x02ab" + struct.pack("!HHHH", 6, 0x1301, 0x0A0A, 0x1302) + b"\x01\x00" + struct.pack("!H", len(exts)) + exts
    shake = b"\x01" + len(body).to_bytes(3, "big") + body
    return b"\x16\x03\x01" + struct.pack("!H", len(shake)) + shake


def test_tls_facts():
    t = P.tls(client_hello())
    assert (t["version"], t["session_id_len"], t["ciphers"], t["sni"], t["alpn"]) == (0x303, 2, [0x1301, 0x0A0A, 0x1302], "example.com", "h2")
    assert (t["curves"], t["formats"], t["share_group"], t["share_bits"], t["whole"]) == ([29, 23], [0], 29, 256, True)
    assert t["extensions"] == [0, 0x0A0A, 10, 11, 16, 35, 51]
    for cut in range(len(client_hello())):
        P.tls(client_hello()[:cut])


def test_tls_features_and_fingerprint(spark):
    import hashlib

    data = client_hello()
    rows = tcp_session()
    rows[3] |= {"raw_payload": data, "payload_len": len(data)}
    r = extract(frame(spark, rows), Config(groups=("tls", "entropy"))).collect()[0]
    want = hashlib.md5(b"771,4865-4866,0-10-11-16-35-51,29-23,0").hexdigest()
    assert (r.tls_detected, r.tls_sni, r.ja3_hash, r.tls_cipher_count, r.tls_extension_count) == (True, "example.com", want, 3, 7)
    assert (r.tls_session_resumed, r.tls_key_exchange_group_name, r.tls_version_str) == (True, "x25519", "TLS 1.2")
    assert r.payload_bytes_sampled == min(256, len(data)) and 0 < r.entropy_payload < 8


def test_dns_ssh_quic_http2_facts():
    query = struct.pack("!HHHHHH", 1, 0x8180, 1, 2, 0, 0) + b"\x03www\x01a\x00" + struct.pack("!HH", 1, 1)
    for ttl in (300, 60):
        query += b"\xc0\x0c" + struct.pack("!HHIH", 1, 1, ttl, 4) + b"\1\2\3\4"
    d = P.dns(query)
    assert (d["name"], d["type"], d["response"], d["code"], d["min_ttl"], d["max_ttl"], d["desired"], d["available"]) == ("www.a", 1, True, 0, 60, 300, True, True)
    loop = struct.pack("!HHHHHH", 1, 0, 1, 0, 0, 0) + b"\xc0\x0c"
    assert P.dns(loop)["response"] is False
    assert P.ssh(b"SSH-2.0-OpenSSH_9.0 Debian\r\n")["software"] == "OpenSSH_9.0"
    lists = [b"k1,k2", b"h", b"e1", b"e2", b"m1", b"m2", b"none", b"zlib"]
    body = b"\x14" + b"c" * 16 + b"".join(struct.pack("!I", len(x)) + x for x in lists)
    s = P.ssh(struct.pack("!IB", len(body) + 5, 4) + body)
    assert (s["client_lists"], s["server_lists"]) == ("k1,k2;e1;m1;none", "k1,k2;e2;m2;zlib")
    ext = struct.pack("!HBH", 14, 0, 11) + b"example.com"
    q = P.quic(b"\xc3\0\0\0\1" + b"\x11" * 9 + b"\0\0" + struct.pack("!H", len(ext)) + ext + b"\0\x10\0\5\0\3\2h3" + b"\x01" * 12)
    assert (q["sni"], q["alpn"]) == ("example.com", "h3")
    h = P.http2(b"\0\0\2\1\4\0\0\0\1ab" + b"\0\0\0\4\0\0\0\0\0")
    assert (h["types"], h["streams"], h["like"], h["preface"]) == ([1, 4], [1, 0], True, False)


def test_labels(spark):
    rows = tcp_session() + [packet(20, 0, ("1.1.1.1", 5), ("2.2.2.2", 6), proto=17)]
    features = extract(frame(spark, rows), Config(groups=("flow_meta",)))
    labels = spark.createDataFrame([("10.0.0.1", "192.168.1.100", 443, 54321, 6, "web", 1), ("10.0.0.1", "192.168.1.100", 443, 54321, 6, "later", 2)], "src_ip string, dst_ip string, src_port int, dst_port int, protocol int, label string, n int")
    got = {r.src_ip: r.label for r in label_sessions(features, labels, order="n").collect()}
    assert got == {"192.168.1.100": "later", "1.1.1.1": "unknown"}
    assert {r.label: r.n for r in label_counts(labels).collect()} == {"web": 1, "later": 1}
    assert [r.label for r in unique_labels(labels).collect()] == ["later", "web"]


def test_sinks(spark, tmp_path):
    df = extract(frame(spark, tcp_session()), Config(groups=("timing",), include_splt=True))
    for form in ("csv", "json", "parquet"):
        sinks.write_files(df, str(tmp_path / form), form)
        assert spark.read.format(form).load(str(tmp_path / form)).count() >= 1
    assert "iat_mean" in sinks.messages(df).first().value
    assert sinks.jdbc_url("postgresql://u:p@h:1/d") == "jdbc:postgresql://h:1/d" and sinks.jdbc_url("sqlite:///x.db") == "jdbc:sqlite:x.db"
    assert "splt" not in sinks.numeric(df).columns
    record = sinks.provenance(Config(), "here", 1)
    sinks.write_provenance(df, str(tmp_path / "made"), record)
    assert record["config_sha256"] in spark.read.text(str(tmp_path / "made")).first().value


def test_config():
    assert Config.from_dict(Config(groups=("tcp",)).to_dict()) == Config(groups=("tcp",))
    assert Config(anonymization_salt="a").digest() == Config(anonymization_salt="b").digest()
    for bad in ({"flow_timeout": 0}, {"sampling_rate": 2.0}, {"profile": "none"}):
        with pytest.raises(ValueError):
            Config(**bad)
    with pytest.raises(ValueError):
        Config.from_dict({"nothing": 1})
