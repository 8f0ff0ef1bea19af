import json
import os
import time

import pytest
from packets import frame, packet, tcp_session

from rillstream import cli
from rillstream.config import Config
from rillstream.operators.labels import label_sessions, lookup, read_labels
from rillstream.plans import registry
from rillstream.plans.extract import extract
from rillstream.sources import pcap

LABELS = [("192.168.1.100", "10.0.0.1", "first"), ("192.168.1.100", "10.0.0.1", "aardvark"), ("1.1.1.1", "2.2.2.2", None)]


@pytest.mark.parametrize("form", ["csv", "json", "jsonl", "plain"])
def test_label_files(spark, tmp_path, form):
    rows = [dict(zip(("src_ip", "dst_ip", "label"), r)) for r in LABELS]
    where = tmp_path / (f"labels.{form}" if form != "plain" else "labels")
    if form == "json":
        where.write_text(json.dumps(rows, indent=1))
    elif form == "csv":
        where.write_text("src_ip,dst_ip,label\n" + "\n".join(",".join(x or "" for x in r) for r in LABELS))
    else:
        where.write_text("\n" + "\n".join(map(json.dumps, rows)))
    got = read_labels(spark, str(where))
    assert sorted(r.label for r in got.collect()) == ["aardvark", "first", "unknown"]
    features = extract(frame(spark, tcp_session()), Config(groups=("flow_meta",)))
    # the last written label of a session wins
    assert [r.label for r in label_sessions(features, got).collect()] == ["aardvark"]
    with pytest.raises(ValueError):
        read_labels(spark, str(where), form="xml")


def test_labels_without_their_column_and_the_last_written(spark, tmp_path):
    (tmp_path / "a.csv").write_text("src_ip,name\n1,2\n")
    with pytest.raises(ValueError):
        read_labels(spark, str(tmp_path / "a.csv"))
    labels = spark.createDataFrame([(1, "z"), (1, "a"), (2, "b")], "k int, label string").coalesce(1)
    keys = spark.createDataFrame([(1,), (3,), (None,)], "k int")
    assert {(r.k, r.label) for r in lookup(keys, labels, ["k"]).collect()} == {(1, "a"), (3, "unknown"), (None, "unknown")}


def test_options_from_files_and_a_filter(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("flow_timeout: 5\ngroups: [flow_meta]\nbpf_filter: tcp and dst port 443\n")
    (tmp_path / "none.yml").write_text("")
    cfg = Config.from_file(str(tmp_path / "c.yaml"))
    assert cfg.flow_timeout == 5 and cfg.groups == ("flow_meta",) and Config.from_file(str(tmp_path / "none.yml")) == Config()
    rows = [*tcp_session(), packet(90, 0, ("10.1.2.3", 5353), ("10.1.9.9", 53), proto=17)]
    got = extract(frame(spark, rows), cfg).collect()
    assert [r.total_packets for r in got] == [5]
    with pytest.raises(ValueError):
        Config.from_dict({"no_such_option": 1})


def test_graph_metrics_are_an_option(spark):
    got = extract(frame(spark, tcp_session()), Config(groups=("flow_meta", "connection"), connection_include_graph_metrics=False))
    assert "conn_src_total_flows" in got.columns and "conn_src_betweenness" not in got.columns
    assert got.first().conn_src_total_flows == 1


def test_command_line(spark, tmp_path, capsys):
    frame(spark, tcp_session()).write.parquet(str(tmp_path / "p.parquet"))
    (tmp_path / "l.csv").write_text("src_ip,label\n192.168.1.100,mine\n")
    out = str(tmp_path / "f")
    assert cli.main(["extract", str(tmp_path / "p.parquet"), out, "--groups", "flow_meta", "--filter", "tcp", "--timeout", "30", "--no-ports", "--labels", str(tmp_path / "l.csv")]) == 0
    got = spark.read.parquet(out)
    assert "src_port" not in got.columns and [r.label for r in got.collect()] == ["mine"]
    assert cli.main(["validate", out, out, "--keys", "src_ip", "dst_ip"]) == 0
    got.withColumn("total_packets", got.total_packets + 1).write.parquet(str(tmp_path / "g"))
    assert cli.main(["validate", out, str(tmp_path / "g"), "--keys", "src_ip", "dst_ip"]) == 1
    capsys.readouterr()
    assert cli.main(["profiles"]) == 0 and capsys.readouterr().out.split()[:2] == ["core", "151"]
    assert registry.csv_text().startswith("id,name,group,tier,dtype\n") and len(registry.csv_text().splitlines()) == 413


def test_a_stream_takes_each_file_once_in_any_order(tmp_path):
    reader = pcap._Stream({"path": str(tmp_path)})
    (tmp_path / "m.pcap").write_bytes(b"x" * 10)
    first = reader.latestOffset()
    assert first == {"files": ["m.pcap"]}
    (tmp_path / "a.pcap").write_bytes(b"x")
    assert [os.path.basename(p.path) for p in reader.partitions(first, reader.latestOffset())] == ["a.pcap"]
    slow = pcap._Stream({"path": str(tmp_path), "settleSeconds": "60"})
    assert slow.latestOffset() == {"files": []}
    old = time.time() - 100
    os.utime(tmp_path / "a.pcap", (old, old))
    assert slow.latestOffset() == {"files": ["a.pcap"]}
    os.utime(tmp_path / "m.pcap", (old, old))
    (tmp_path / "m.pcap").write_bytes(b"x" * 20)
    os.utime(tmp_path / "m.pcap", (old, old))
    assert slow.latestOffset() == {"files": ["a.pcap"]}  # it has grown since the last look
    assert slow.latestOffset() == {"files": ["a.pcap", "m.pcap"]}
