"""Sessions of a packet stream, in window functions over one sort.

Rows of one canonical endpoint pair are taken in arrival order. A row opens a session if it is the first, if it comes more than the
timeout after the row before, or if that row, not an opening one itself, had FIN or RST. The last rule seems recursive, but a
row whose predecessor carries neither flag (or that a gap precedes) is decided by the gap alone, and from such an anchor on opening
and closing rows alternate: a row opens exactly if its anchor does and it stands an even number of rows behind it, or its
anchor does not and the number is odd.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..schema import FIN, RST, flag

KEY = ["file_id", "ip_a", "port_a", "ip_b", "port_b", "protocol"]
SESSION = [*KEY, "session_no"]


def canonical(df: DataFrame) -> DataFrame:
    """Adds the endpoints in canonical order: the smaller (address as a string, then port) first."""
    src, dst = F.struct("src_ip", "src_port"), F.struct("dst_ip", "dst_port")
    first = src <= dst

    def pick(x: str, y: str) -> Column:
        return F.when(first, F.col(x)).otherwise(F.col(y))

    return df.withColumns({"ip_a": pick("src_ip", "dst_ip"), "port_a": pick("src_port", "dst_port"), "ip_b": pick("dst_ip", "src_ip"), "port_b": pick("dst_port", "src_port")})


def sample(df: DataFrame, cfg: Config) -> DataFrame:
    """A seeded Bernoulli sample of the packets, if one is asked for."""
    return df if cfg.sampling_rate is None else df.sample(False, cfg.sampling_rate, cfg.sampling_seed)


def sessionize(packets: DataFrame, cfg: Config | None = None) -> DataFrame:
    """Packets with ``session_no`` (from 1 within a key), ``pos`` (from 1 within a session), ``fwd`` and ``close_reason``.

    ``fwd`` is whether a packet comes from the endpoint that opened its session. ``close_reason`` is ``completed`` where a
    terminator ended the session, ``expired`` where a gap did, else ``flushed``. Null flags carry no terminator.
    """
    cfg = cfg or Config()
    w = Window.partitionBy(*KEY).orderBy("ord")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    ends = flag(FIN | RST) if cfg.terminate_on_fin_rst else F.lit(False)
    df = canonical(packets).withColumn("ends", ends)
    df = df.withColumns({"row": F.row_number().over(w), "before": F.lag("ts_us").over(w), "ended": F.coalesce(F.lag("ends").over(w), F.lit(False))})
    df = df.withColumn("gap", F.col("before").isNull() | (F.col("ts_us") - F.col("before") > cfg.timeout_us))
    anchor = F.col("gap") | ~F.col("ended")
    df = df.withColumns({"anchor": F.max(F.when(anchor, F.col("row"))).over(so_far), "anchor_gap": F.last(F.when(anchor, F.col("gap")), ignorenulls=True).over(so_far)})
    opens = F.when((F.col("row") - F.col("anchor")) % 2 == 0, F.col("anchor_gap")).otherwise(~F.col("anchor_gap"))
    df = df.withColumn("opens", opens).withColumn("session_no", F.sum(F.col("opens").cast("long")).over(so_far))
    s = Window.partitionBy(*SESSION).orderBy("ord")
    whole = s.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumn("next_gap", F.coalesce(F.lead("gap").over(w), F.lit(False)))
    df = df.withColumns({"pos": F.row_number().over(s), "init_ip": F.first("src_ip").over(s), "init_port": F.first("src_port").over(s)})
    df = df.withColumn("fwd", (F.col("src_ip") == F.col("init_ip")) & (F.col("src_port") == F.col("init_port")))
    closed = F.when(F.last("ends").over(whole) & ~F.last("opens").over(whole), F.lit("completed")).when(F.last("next_gap").over(whole), F.lit("expired")).otherwise(F.lit("flushed"))
    return df.withColumn("close_reason", closed).drop("ends", "row", "before", "ended", "gap", "anchor", "anchor_gap", "opens", "next_gap")
