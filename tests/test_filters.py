import pytest
from packets import CLIENT, SERVER, frame, packet, tcp_session

from rillstream.config import Config
from rillstream.operators import filters
from rillstream.plans.extract import extract

ROWS = [*tcp_session(), packet(50, 0, ("10.1.2.3", 5353), ("10.1.9.9", 53), proto=17, vlan_id=4), packet(51, 0, ("::1", 0), ("::2", 0), proto=58, ip_version=6)]


@pytest.mark.parametrize(
    "text,orders",
    [
        ("tcp", set(range(8))),
        ("udp port 53", {50}),
        ("src port 443 and greater 1000", {4, 5}),
        ("not tcp and not ip6", {50}),
        ("net 10.1.0.0/16 or icmp6", {50, 51}),
        ("dst net 10.1.9.0/24 && (udp || tcp)", {50}),
        ("host 10.0.0.1 and dst portrange 50000-60000", {1, 4, 5}),
        ("vlan", {50}),
    ],
)
def test_capture_filters(spark, text, orders):
    got = frame(spark, ROWS).where(filters.expression(text)).select("ord").collect()
    assert {r.ord for r in got} == orders


@pytest.mark.parametrize("text", ["", "port", "(tcp", "tcp tcp", "nothing 5"])
def test_filters_that_do_not_read(spark, text):
    with pytest.raises(ValueError):
        filters.expression(text)


def test_packets_of_sockets(spark):
    kind = "protocol int, local_ip string, local_port int, remote_ip string, remote_port int"
    exact = spark.createDataFrame([(6, *CLIENT, *SERVER)], kind)
    assert {r.ord for r in filters.of_sockets(frame(spark, ROWS), exact).collect()} == set(range(8))
    listening = spark.createDataFrame([(17, "0.0.0.0", 53, None, None), (6, "1.1.1.1", 443, "0.0.0.0", 0)], kind)
    assert {r.ord for r in filters.of_sockets(frame(spark, ROWS), listening).collect()} == {50}


def test_differences_from_golden_rows(spark):
    features = extract(frame(spark, tcp_session()), Config(groups=("flow_meta",)))
    golden = spark.createDataFrame([(CLIENT[0], 8, 1.0 + 1e-12, None, 99)], "src_ip string, total_packets long, duration double, hdr_desc string, bytes_fwd long")
    got = {r.feature for r in filters.differences(features, golden, ["src_ip"]).collect()}
    assert got == {"hdr_desc", "bytes_fwd"}
