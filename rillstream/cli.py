"""``python -m rillstream.cli extract|info|catalogue|profiles|validate|watch ...``; run it by spark-submit on a cluster."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from .config import Config
from .operators.filters import differences, expression
from .operators.labels import label_sessions, read_labels
from .operators.sinks import provenance, write_files, write_provenance
from .plans import registry
from .plans.extract import extract
from .schema import conform
from .session import session
from .sources.pcap import CaptureSource
from .streaming.sessions import stream_sessions


def _packets(spark, path: str):
    spark.dataSource.register(CaptureSource)
    return spark.read.parquet(path) if path.endswith(".parquet") else spark.read.format("capture").load(path)


#: Command-line options that set an option of ``Config`` to a value, and those that turn one.
VALUES = {
    "timeout": ("flow_timeout", float),
    "filter": ("bpf_filter", str),
    "sample": ("sampling_rate", float),
    "salt": ("anonymization_salt", str),
    "burst-ms": ("burst_threshold_ms", float),
    "entropy-bytes": ("entropy_sample_bytes", int),
    "sequence": ("max_sequence_length", int),
}
TURNS = {
    "no-terminate": ("terminate_on_fin_rst", False),
    "no-ips": ("include_ip_addresses", False),
    "no-ports": ("include_ports", False),
    "anonymize": ("anonymize_ips", True),
    "flow-id": ("include_flow_id", True),
    "raw-sequences": ("include_raw_sequences", True),
    "splt": ("include_splt", True),
    "split": ("bidirectional_split", True),
    "graph-ports": ("connection_use_ports", True),
    "graph-temporal": ("connection_include_temporal", True),
    "no-graph-metrics": ("connection_include_graph_metrics", False),
}


def _options(p: argparse.ArgumentParser) -> None:
    p.add_argument("--config", help="a JSON or YAML file of options; what is given here goes before it")
    p.add_argument("--groups", nargs="*")
    p.add_argument("--features", nargs="*")
    p.add_argument("--profile", choices=registry.TIERS)
    for name, (_, kind) in VALUES.items():
        p.add_argument(f"--{name}", type=kind)
    for name in TURNS:
        p.add_argument(f"--{name}", action="store_true")


def _config(o: argparse.Namespace) -> Config:
    given = {k: getattr(o, k) for k in ("groups", "features", "profile") if getattr(o, k)}
    given |= {option: v for name, (option, _) in VALUES.items() if (v := getattr(o, name.replace("-", "_"))) is not None}
    given |= {option: v for name, (option, v) in TURNS.items() if getattr(o, name.replace("-", "_"))}
    return Config.from_dict((Config.from_file(o.config) if o.config else Config()).to_dict() | given)


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="rillstream")
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("extract", help="features of a capture, a folder of captures or a packet table")
    e.add_argument("source")
    e.add_argument("target")
    e.add_argument("--format", default="parquet", choices=("parquet", "csv", "json"))
    e.add_argument("--mode", default="errorifexists", choices=("errorifexists", "overwrite", "append"))
    _options(e)
    e.add_argument("--labels", help="a label file: adds the column label")
    e.add_argument("--provenance")
    w = sub.add_parser("watch", help="sessions of the captures that come to a folder, as rows are finished")
    w.add_argument("source")
    w.add_argument("target")
    w.add_argument("--checkpoint", required=True)
    w.add_argument("--once", action="store_true", help="take what is there and end")
    _options(w)
    sub.add_parser("profiles", help="the profiles and their number of features")
    v = sub.add_parser("validate", help="compare a feature table with a golden one; ends with 1 where they differ")
    v.add_argument("features")
    v.add_argument("golden")
    v.add_argument("--keys", nargs="+", required=True)
    v.add_argument("--tolerance", type=float, default=1e-9)
    i = sub.add_parser("info", help="packets by protocol")
    i.add_argument("source")
    c = sub.add_parser("catalogue", help="the features")
    c.add_argument("--as", dest="form", default="markdown", choices=("markdown", "json", "csv"))
    o = p.parse_args(args)
    spark = session("rillstream")
    if o.command == "catalogue":
        print({"markdown": registry.markdown, "csv": registry.csv_text, "json": lambda: json.dumps(registry.as_dicts(), indent=1)}[o.form]())
        return 0
    if o.command == "profiles":
        for tier in registry.TIERS:
            print(tier, len(registry.names_of(tier)))
        return 0
    if o.command == "validate":
        found = differences(spark.read.parquet(o.features), spark.read.parquet(o.golden), o.keys, o.tolerance)
        n = found.count()
        found.show(20, False)
        print(f"{n} differences")
        return 1 if n else 0
    if o.command == "watch":
        spark.dataSource.register(CaptureSource)
        cfg = _config(o)
        packets = conform(spark.readStream.format("capture").load(o.source))
        sessions = stream_sessions(packets.where(expression(cfg.bpf_filter)) if cfg.bpf_filter else packets, cfg)
        query = sessions.writeStream.format("parquet").option("path", o.target).option("checkpointLocation", o.checkpoint).outputMode("append")
        (query.trigger(availableNow=True) if o.once else query).start().awaitTermination()
        return 0
    packets = conform(_packets(spark, o.source))
    if o.command == "info":
        packets.groupBy("protocol").agg(F.count("*").alias("packets"), F.sum("total_len").alias("bytes")).orderBy(F.desc("packets")).show()
        return 0
    cfg = _config(o)
    features = extract(packets, cfg)
    if o.labels:
        features = label_sessions(features, read_labels(spark, o.labels))
    write_files(features, o.target, o.format, o.mode)
    if o.provenance:
        write_provenance(features, o.provenance, provenance(cfg, o.source))
    return 0


if __name__ == "__main__":
    sys.exit(main())
