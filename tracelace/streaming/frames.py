"""Frame-ordered streams: linking with carried motion, sliding windows of frames, and late points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracelace.operators.linkers import Motion, link_frame

#: Links and late points; a late point has its own id as source and no target.
OUT = "dataset string, kind string, t int, source_id long, target_id long"
_STATE = "closed int, open_t array<int>, open_id array<long>, open_z array<double>, open_y array<double>, open_x array<double>, prev_id array<long>, prev_pos array<double>, prev_v array<double>"


def linked(points: DataFrame, knobs: Motion = Motion(), patience: int = 1) -> DataFrame:
    """Links of a stream of points (dataset, node_id, t, uz, uy, ux), the same as the batch linker's once frames are complete.

    A frame is closed when a point ``patience`` frames later has come; closed frames are linked in order, and the state
    holds the open frames' points and the last closed frame with its velocities. A point of a closed frame is late and comes
    out as such. To close the last frames, send a point further on (its frame stays open).
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(batches), ignore_index=True)
        closed, prev, still = -1, None, pd.DataFrame(columns=["t", "node_id", "uz", "uy", "ux"])
        if state.exists:
            closed, t, i, z, y, x, pid, pos, vel = state.get
            still = pd.DataFrame({"t": t, "node_id": i, "uz": z, "uy": y, "ux": x})
            prev = pd.DataFrame({"node_id": np.array(pid, "int64")})
            prev[["uz", "uy", "ux"]] = np.array(pos, float).reshape(-1, 3)
            prev[["vz", "vy", "vx"]] = np.array(vel, float).reshape(-1, 3)
        late = new[new["t"] <= closed]
        out = [(key[0], "late", int(r.t), int(r.node_id), None) for r in late.itertuples(index=False)]
        held = new[new["t"] > closed][["t", "node_id", "uz", "uy", "ux"]]
        held = pd.concat([still, held], ignore_index=True) if len(still) else held
        reach = int(max(closed + patience, held["t"].max())) - patience if len(held) else closed
        for t in range(closed + 1, reach + 1):
            frame = held[held["t"] == t].sort_values("node_id").assign(vz=0.0, vy=0.0, vx=0.0)
            if prev is not None and len(prev) and len(frame):
                links, v = link_frame(prev, frame, knobs)
                out += [(key[0], "link", t - 1, s, e) for s, e in links]
                frame[["vz", "vy", "vx"]] = np.array([v[int(n)] for n in frame["node_id"]])
            prev = frame
        closed = max(closed, reach)
        held = held[held["t"] > closed]
        if prev is None:
            prev = pd.DataFrame(columns=["node_id", "uz", "uy", "ux", "vz", "vy", "vx"])
        flat = lambda cols: prev[cols].to_numpy(float).ravel().tolist()
        state.update((closed, held["t"].astype(int).tolist(), held["node_id"].astype(int).tolist(), held["uz"].tolist(), held["uy"].tolist(), held["ux"].tolist(), prev["node_id"].astype(int).tolist(), flat(["uz", "uy", "ux"]), flat(["vz", "vy", "vx"])))
        yield pd.DataFrame(out, columns=["dataset", "kind", "t", "source_id", "target_id"]).astype({"t": "int32", "source_id": "int64", "target_id": "Int64"})

    return points.select("dataset", "node_id", "t", "uz", "uy", "ux").groupBy("dataset").applyInPandasWithState(update, OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, size: str, slide: str, late: str) -> DataFrame:
    """Counts and sums of a stream of events (ts, event_type, value) by window and type; events later than ``late`` are dropped."""
    w = F.window("ts", size, slide)
    g = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("value") * 100).cast("long")).alias("cents"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "cents")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions of a stream of events by user: a pause of ``gap`` ends one."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that the stream gives from what is there now, written to the shared folder and read again."""
    import uuid

    from tracelace.storage import shared_dir

    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/tracelace/{name}-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/log").outputMode(mode).trigger(availableNow=True).start()
    else:
        q = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/rows")).option("checkpointLocation", f"{at}/log").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
