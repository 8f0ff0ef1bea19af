"""Where features go: files, databases, topics, and a record of how they were made."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config

MODES = {"append": "append", "replace": "overwrite", "fail": "errorifexists"}


def flat(df: DataFrame) -> DataFrame:
    """Arrays and structs as JSON text, for sinks without nested types."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema))


def write_files(df: DataFrame, path: str, form: str = "parquet", mode: str = "errorifexists") -> None:
    """``parquet`` keeps nested columns, ``json`` writes a line a row, ``csv`` has a header and nested columns as JSON text."""
    if form == "csv":
        flat(df).write.mode(mode).csv(path, header=True)
    elif form in ("json", "jsonl"):
        df.write.mode(mode).json(path, ignoreNullFields=False)
    elif form == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"unknown format {form!r}")


def jdbc_url(dsn: str) -> str:
    """The JDBC form of a database address."""
    if dsn.startswith("jdbc:"):
        return dsn
    if dsn.startswith(("postgresql://", "postgres://")):
        return "jdbc:postgresql://" + dsn.partition("://")[2].rpartition("@")[2]
    if dsn.startswith("sqlite:///") or dsn.endswith((".db", ".sqlite", ".sqlite3")):
        return "jdbc:sqlite:" + dsn.removeprefix("sqlite:///")
    raise ValueError(f"unknown database {dsn!r}")


def write_database(df: DataFrame, dsn: str, table: str, if_exists: str = "append", batch: int = 1000, **options: str) -> None:
    """Rows to a database by JDBC, in batches; its driver must be on the class path."""
    flat(df).write.mode(MODES[if_exists]).option("batchsize", batch).options(**options).jdbc(jdbc_url(dsn), table)


def messages(df: DataFrame, key: str | None = None) -> DataFrame:
    """``key, value`` of each row: the key column as text, the row as JSON."""
    return df.select((F.col(key).cast("string") if key else F.lit(None).cast("string")).alias("key"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_topic(df: DataFrame, brokers: str, topic: str, key: str | None = None, **options: str) -> None:
    """Rows to a topic, each as JSON; needs Spark's connector on the class path."""
    messages(df, key).write.format("kafka").options(**{"kafka.bootstrap.servers": brokers, "topic": topic}, **options).save()


def numeric(df: DataFrame) -> DataFrame:
    """Numeric and truth columns as doubles, sequences left out: the shape that learners take."""
    kinds = (T.NumericType, T.BooleanType)
    return df.select(*(F.col(f.name).cast("double").alias(f.name) for f in df.schema if isinstance(f.dataType, kinds)))


def provenance(cfg: Config, source: str, rows: int | None = None) -> dict:
    """How features were made: options' digest, what was hidden, and when."""
    return {
        "config_sha256": cfg.digest(),
        "source": source,
        "rows": rows,
        "addresses_shown": cfg.include_ip_addresses and not cfg.anonymize_ips,
        "addresses_hashed": cfg.anonymize_ips,
        "made_at": datetime.now(timezone.utc).isoformat(timespec="seconds"),
    }


def write_provenance(df: DataFrame, path: str, record: dict) -> None:
    """The record as a one-line JSON file beside the features, by Spark's writer, so that any file system will do."""
    df.sparkSession.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
