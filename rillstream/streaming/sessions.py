"""Sessions of an unbounded packet stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Config
from ..operators.sessionize import KEY, canonical
from ..schema import FIN, RST

STATE = "init_ip string, init_port int, start_us long, last_us long, n long, n_fwd long, bytes long, bytes_fwd long, payload long, flags int"
OUTPUT = (
    "file_id string, ip_a string, port_a int, ip_b string, port_b int, protocol int, init_ip string, init_port int, start_us long, end_us long,"
    " total_packets long, packets_fwd long, total_bytes long, bytes_fwd long, payload_bytes long, tcp_flags_agg int, close_reason string"
)


def _fold(timeout_us: int, terminate: bool, idle_ms: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closed: list[tuple] = []
        now = state.get if state.exists else None

        def close(reason: str) -> None:
            closed.append((*key, *now, reason))

        if state.hasTimedOut:
            close("expired")
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("ord", kind="stable")
            flags = rows["tcp_flags"].fillna(0).astype(int)
            for ip, port, us, size, payload, f in zip(rows["src_ip"], rows["src_port"], rows["ts_us"], rows["total_len"], rows["payload_len"], flags):
                if now is not None and us - now[3] > timeout_us:
                    close("expired")
                    now = None
                if now is None:
                    now = (ip, int(port), int(us), int(us), 1, 1, int(size), int(size), int(payload), int(f))
                    continue
                out = int(ip == now[0] and port == now[1])
                now = (*now[:3], int(us), now[4] + 1, now[5] + out, now[6] + int(size), now[7] + out * int(size), now[8] + int(payload), now[9] | int(f))
                if terminate and f & (FIN | RST):
                    close("completed")
                    now = None
            if now is None:
                if state.exists:
                    state.remove()
            else:
                state.update(now)
                state.setTimeoutDuration(idle_ms)
        if closed:
            yield pd.DataFrame(closed, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return step


def stream_sessions(packets: DataFrame, cfg: Config | None = None, idle_ms: int | None = None) -> DataFrame:
    """One row for each session as it closes: by a terminator, a gap, or after ``idle_ms`` of wall-clock silence (the timeout by default).

    The rules are those of the batch sessionizer over the arrival order within a micro-batch. State is one row of sums for each open session.
    """
    cfg = cfg or Config()
    idle = int(cfg.flow_timeout * 1000) if idle_ms is None else idle_ms
    keyed = canonical(packets).select(*KEY, "ord", "ts_us", "src_ip", "src_port", "total_len", "payload_len", "tcp_flags")
    return keyed.groupBy(*KEY).applyInPandasWithState(_fold(cfg.timeout_us, cfg.terminate_on_fin_rst, idle), OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def gap_sessions(packets: DataFrame, cfg: Config | None = None, late: str = "10 minutes") -> DataFrame:
    """Sessions by gaps alone, in event time with a watermark: built-in session windows, no Python. Later packets than the watermark are dropped by Spark."""
    cfg = cfg or Config(terminate_on_fin_rst=False)
    timed = canonical(packets).withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", late)
    window = F.session_window("ts", f"{cfg.timeout_us} microseconds")
    return timed.groupBy(*KEY, window).agg(F.count("*").alias("total_packets"), F.sum("total_len").alias("total_bytes"), F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"))
