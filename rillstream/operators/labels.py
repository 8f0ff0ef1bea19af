"""Labels of sessions, looked up in a label table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LabelSpec


def read_labels(spark: SparkSession, path: str, spec: LabelSpec | None = None, form: str = "auto") -> DataFrame:
    """A label file or folder: ``csv`` with a header, ``json`` (an array, or a line for each object), or ``auto``: by the name, else by the first character.

    A file without the label column is an error. CSV columns are text; a null label counts as the default.
    """
    spec = spec or LabelSpec()
    if form == "auto":
        name = path.rstrip("/").lower()
        if name.endswith((".csv", ".csv.gz")):
            form = "csv"
        elif name.endswith((".json", ".jsonl", ".ndjson", ".json.gz", ".jsonl.gz")):
            form = "json"
        else:
            head = spark.read.text(path).where(F.trim("value") != "").head()
            form = "json" if head and head.value.lstrip()[:1] in ("{", "[") else "csv"
    if form == "csv":
        out = spark.read.csv(path, header=True)
    elif form == "json":
        head = spark.read.text(path).where(F.trim("value") != "").head()
        whole = head is not None and head.value.lstrip().startswith("[")
        out = spark.read.option("primitivesAsString", "true").json(path, multiLine=whole)
    else:
        raise ValueError(f"unknown label format {form!r}")
    if spec.label not in out.columns:
        raise ValueError(f"no label column {spec.label!r} among {out.columns}")
    return out.withColumn(spec.label, F.coalesce(F.col(spec.label), F.lit(spec.default)))


def _one(labels: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One label for each key: the last by ``order``; without one the last written, by the place in the files."""
    placed = labels if order else labels.withColumn("_written", F.monotonically_increasing_id())
    return placed.groupBy(*keys).agg(F.max_by("label", order or "_written").alias("label"))


def lookup(df: DataFrame, labels: DataFrame, keys: list[str], default: str = "unknown", order: str | None = None) -> DataFrame:
    """``df`` with the ``label`` of its keys, or the default. Repeated keys in ``labels`` count once; null keys meet nothing."""
    return df.join(_one(labels, keys, order), keys, "left").withColumn("label", F.coalesce("label", F.lit(default)))


def _text_key(parts: list[Column]) -> Column:
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def label_sessions(features: DataFrame, labels: DataFrame, spec: LabelSpec | None = None, order: str | None = None) -> DataFrame:
    """Features with ``label``: by flow id if the label table has one, else by the endpoints, else by the endpoints turned, else the default.

    Columns that the label table lacks take no part in the match.
    """
    spec = spec or LabelSpec()
    out = features
    found: list[Column] = []
    if spec.flow_id and spec.flow_id in labels.columns and "flow_id" in features.columns:
        own = _one(labels.select(F.col(spec.flow_id).alias("flow_id"), F.col(spec.label).alias("label"), *([order] if order else [])), ["flow_id"], order)
        out = out.join(own.withColumnRenamed("label", "_by_id"), "flow_id", "left")
        found.append(F.col("_by_id"))
    pairs = [("src_ip", spec.src_ip, "dst_ip"), ("dst_ip", spec.dst_ip, "src_ip"), ("src_port", spec.src_port, "dst_port"), ("dst_port", spec.dst_port, "src_port"), ("protocol", spec.protocol, "protocol")]
    used = [p for p in pairs if p[1] in labels.columns and p[0] in features.columns]
    if used:
        key = _text_key([F.col(c) for _, c, _ in used])
        own = _one(labels.select(key.alias("_key"), F.col(spec.label).alias("label"), *([order] if order else [])), ["_key"], order)
        for name, column in (("_fwd", 0), ("_bwd", 2)):
            out = out.withColumn("_key", _text_key([F.col(p[column]) for p in used])).join(own.withColumnRenamed("label", name), "_key", "left").drop("_key")
            found.append(F.col(name))
    return out.withColumn("label", F.coalesce(*found, F.lit(spec.default))).drop("_by_id", "_fwd", "_bwd")


def label_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count("*").alias("n"))


def unique_labels(labels: DataFrame) -> DataFrame:
    return labels.select("label").distinct().orderBy("label")
