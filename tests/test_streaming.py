import time

from packets import CLIENT, SERVER, frame, packet, tcp_session

from rillstream.config import Config
from rillstream.streaming.sessions import gap_sessions, stream_sessions


def drain(df, out, where, rows):
    """Run until so many rows are processed; time-outs by the wall clock make such a stream run on by itself."""
    q = df.writeStream.outputMode("append").format("parquet").option("path", str(out)).option("checkpointLocation", str(where)).start()
    seen, until = {}, time.time() + 60
    while sum(seen.values()) < rows and time.time() < until:
        time.sleep(0.2)
        seen |= {p["batchId"]: max(p["numInputRows"], seen.get(p["batchId"], 0)) for p in q.recentProgress}
    q.stop()
    assert sum(seen.values()) == rows


def test_sessions_close_across_micro_batches(spark, tmp_path):
    rows = tcp_session()
    late = [packet(20, 1_100_000_000, SERVER, CLIENT, flags=17), packet(21, 1_300_000_000, SERVER, CLIENT, flags=16)]
    folder, out, where = tmp_path / "in", tmp_path / "out", tmp_path / "c"
    frame(spark, rows[:5]).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(frame(spark, []).schema).parquet(str(folder))
    closed = stream_sessions(stream, Config(flow_timeout=60), idle_ms=10**9)
    drain(closed, out, where, 5)
    assert spark.read.schema(closed.schema).parquet(str(out)).count() == 0
    frame(spark, rows[5:] + late).coalesce(1).write.mode("append").parquet(str(folder))
    drain(closed, out, where, 5)
    got = {r.close_reason: r for r in spark.read.schema(closed.schema).parquet(str(out)).collect()}
    done = got["completed"]
    assert (done.total_packets, done.packets_fwd, done.total_bytes, done.payload_bytes, done.end_us - done.start_us) == (8, 5, 3320, 3000, 1_000_000)
    assert (got["expired"].total_packets, got["expired"].init_ip) == (1, SERVER[0])


def test_gap_sessions_are_built_in_windows(spark):
    rows = [packet(0, 0), packet(1, 60_000_000), packet(2, 200_000_000)]
    got = sorted(r.total_packets for r in gap_sessions(frame(spark, rows), Config(flow_timeout=60)).collect())
    assert got == [1, 2]
