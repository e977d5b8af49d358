"""Streams of face observations: trust, score history, enrolment, frame statistics, presence, capture.

Streams carry face_id, camera, ts (timestamp), frame_id, the box, spoof_probability, vec_id and stage times.
What has no event time in a camera loop gets one here: a watermark decides how late a row may be.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from presentia.functions.vectors import finite
from presentia.operators import galleries as G
from presentia.operators.frames import HISTORY, LEAST_FACE, MIN_GAP, STRIDE, with_cells
from presentia.operators.trust import enroll_reject_reason, is_live, recognize
from presentia.plans.materialize import materialize
from presentia.sources import gallery_store as store


def read_faces(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Face observations from Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_trust(faces: DataFrame, embeddings: DataFrame, gallery: DataFrame, threshold: float, sink: str, checkpoint: str) -> StreamingQuery:
    """Every observation with identity and status. Each batch writes its own folder, so a repeated batch replaces itself."""

    def one(batch: DataFrame, number: int) -> None:
        recognize(batch, embeddings, gallery, threshold).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return faces.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _History(StatefulProcessor):
    """The last scores of one grid cell; they leave when the cell stays unseen for the time to live."""

    def __init__(self, n: int, ttl_ms: int):
        self.n, self.ttl_ms = n, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scores = handle.getListState("scores", "score double")
        self.seen = handle.getValueState("seen", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        data = pd.concat(list(rows)).sort_values(["at", "face_id"])
        held = [r[0] for r in self.scores.get()] if self.scores.exists() else []
        last = self.seen.get()[0] if self.seen.exists() else None
        out = []
        for r in data.itertuples(index=False):
            if last is not None and r.at - last > self.ttl_ms:
                held = []
            held = [*held, float(r.spoof_probability)][-self.n :]
            last = int(r.at)
            out.append((key[0], key[1], key[2], int(r.face_id), len(held), sum(held) / len(held)))
        self.scores.put([(s,) for s in held])
        self.seen.update((last,))
        yield pd.DataFrame(out, columns=["camera", "cell_x", "cell_y", "face_id", "n", "mean_score"])

    def close(self) -> None:
        pass


def stream_score_history(faces: DataFrame, ttl_ms: int, n: int = HISTORY) -> DataFrame:
    """camera, cell, face_id, n, mean_score: :func:`presentia.operators.frames.score_history` with event time for ticks.

    State is at most ``n`` scores for each cell. Needs the RocksDB state store.
    """
    scored = with_cells(faces.filter("spoof_probability is not null")).withColumn("at", F.unix_millis("ts"))
    keyed = scored.select("camera", "cell_x", "cell_y", "face_id", "at", "spoof_probability").groupBy("camera", "cell_x", "cell_y")
    schema = "camera bigint, cell_x int, cell_y int, face_id bigint, n bigint, mean_score double"
    return keyed.transformWithStateInPandas(_History(n, ttl_ms), schema, "Append", "None")


class _Gaps(StatefulProcessor):
    """Of one camera: the usable faces that are alone in their frame and far enough from the last one accepted of their name.

    State is one frame number for each name.
    """

    def __init__(self, min_gap: int):
        self.min_gap = min_gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "name string", "frame_id bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        data = pd.concat(list(rows))
        alone = data.groupby("frame_id")["face_id"].transform("size") == 1
        data, held, out = data[alone & data["usable"]].sort_values(["frame_id", "face_id"]), {}, []
        for r in data.itertuples(index=False):
            if r.name not in held:
                held[r.name] = self.last.getValue((r.name,))[0] if self.last.containsKey((r.name,)) else None
            if held[r.name] is None or r.frame_id - held[r.name] >= self.min_gap:
                held[r.name] = int(r.frame_id)
                out.append((r.name, key[0], int(r.frame_id), int(r.face_id), int(r.vec_id)))
        for name in {r[0] for r in out}:
            self.last.updateValue((name,), (held[name],))
        yield pd.DataFrame(out, columns=["name", "camera", "frame_id", "face_id", "vec_id"])

    def close(self) -> None:
        pass


class _Enrolled(StatefulProcessor):
    """Of one name: the accepted frames, with their vectors where the gallery takes them; state is those it has, ``cap`` at most."""

    def __init__(self, cap: int, duplicate: float):
        self.cap, self.duplicate = cap, duplicate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.vectors = handle.getListState("vectors", "v array<double>")

    def handleInitialState(self, key, old: pd.DataFrame, timer) -> None:
        """The vectors of the gallery at the start, in order."""
        self.vectors.put([([float(x) for x in v],) for v in old.sort_values("ordinal")["v"][: self.cap]])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        data = pd.concat(list(rows)).sort_values("face_id")
        held = [np.array(v, float) for (v,) in self.vectors.get()] if self.vectors.exists() else []
        units, out = [G.unit_vector(v) for v in held], []
        for r in data.itertuples(index=False):
            kept = False
            if len(units) < self.cap:  # a full name only passes its frames on
                unit = G.unit_vector(np.array(r.v, float))
                kept = not units or max(float(u @ unit) for u in units) < self.duplicate
            if kept:
                units.append(unit)
                self.vectors.appendValue(([float(x) for x in r.v],))
            out.append((key[0], int(r.camera), int(r.frame_id), int(r.face_id), [float(x) for x in r.v] if kept else None, kept))
        yield pd.DataFrame(out, columns=["name", "camera", "frame_id", "face_id", "v", "kept"])

    def close(self) -> None:
        pass


def stream_enroll(
    faces: DataFrame, embeddings: DataFrame, root: str, dim: int, threshold: float, frame: tuple[int, int], checkpoint: str, min_gap: int = MIN_GAP, cap: int = G.CAP, duplicate: float = G.DUPLICATE
) -> StreamingQuery:
    """Usable live faces are enrolled by the rules of :func:`presentia.operators.galleries.enroll`; each batch that brings any makes one gallery version.

    ``faces`` has a ``name`` column. A face is usable if its frame (camera, frame_id) has no other, it is live, has an
    embedding of ``dim`` finite numbers and none of the reasons against it; accepted frames of a name and camera lie
    ``min_gap`` apart, also across batches. What must be known of the past is keyed state: the last frame of each camera
    and name, and the vectors of each name, which start as those of the gallery. A batch writes the vectors that it
    adds and the frames that it accepted (below ``root``-accepted), so it costs what it brings. Versions remember the
    batch, and a repeated one adds nothing. Needs the RocksDB state store.
    """
    spark = faces.sparkSession
    good = enroll_reject_reason(*frame, threshold).isNull() & is_live(F.col("spoof_probability"), threshold) & F.col("vec_id").isNotNull() & (F.trim("name") != "")
    good = F.coalesce(good, F.lit(False))
    usable = faces.select("camera", "frame_id", "face_id", F.when(good, F.trim("name")).alias("name"), F.when(good, F.col("vec_id")).alias("vec_id"), good.alias("usable"))
    gaps = usable.groupBy("camera").transformWithStateInPandas(_Gaps(min_gap), "name string, camera bigint, frame_id bigint, face_id bigint, vec_id bigint", "Append", "None")
    known = embeddings.select("vec_id", F.col("v").cast("array<double>").alias("v")).filter((F.size("v") == dim) & finite(F.col("v")))
    accepted = gaps.join(known, "vec_id").select("name", "camera", "frame_id", "face_id", "v")
    old = G.read_gallery(spark, root, dim).select("name", "ordinal", F.col("v").cast("array<double>").alias("v"))
    enrolled = accepted.groupBy("name").transformWithStateInPandas(
        _Enrolled(cap, duplicate), "name string, camera bigint, frame_id bigint, face_id bigint, v array<double>, kept boolean", "Append", "None", old.groupBy("name")
    )

    def one(batch: DataFrame, number: int) -> None:
        batch = materialize(batch, "enroll-batch")  # state moves once
        batch.select("name", "camera", "frame_id").write.mode("overwrite").parquet(f"{root}-accepted/batch={number}")
        new = batch.filter("kept").select("name", (F.col("face_id") + F.lit(1 << 40)).alias("ordinal"), "v")
        store.append(new, root, (store.stream_name(batch.sparkSession, checkpoint), number))
        store.compact(batch.sparkSession, root, 64)

    return enrolled.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def frame_stats(faces: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """camera, window bounds, faces, mean stage times; later rows than the watermark allows are dropped and counted by Spark."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = faces.withWatermark("ts", late).groupBy("camera", w.alias("w")).agg(
        F.count(F.lit(1)).alias("faces"), F.avg("detect_ms").alias("detect_ms"), F.avg("liveness_ms").alias("liveness_ms"), F.percentile_approx("recognize_ms", 0.5).alias("recognize_ms")
    )
    return out.select("camera", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "faces", "detect_ms", "liveness_ms", "recognize_ms")


def presence(faces: DataFrame, gap: str = "6 hours", late: str = "6 hours") -> DataFrame:
    """camera, cell, start, end, faces: how long a cell was seen without a pause of ``gap``. Batch or stream."""
    cells = with_cells(faces)
    if faces.isStreaming:
        cells = cells.withWatermark("ts", late)
    out = cells.groupBy("camera", "cell_x", "cell_y", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("faces"))
    return out.select("camera", "cell_x", "cell_y", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "faces")


def stream_capture(faces: DataFrame, sink: str, checkpoint: str, target: int = 100, stride: int = STRIDE, least: int = LEAST_FACE) -> StreamingQuery:
    """Appends usable frames to the manifest at ``sink`` until it holds ``target``; each batch fills up what is missing.

    A batch leaves how many there are after it in one row below ``sink``-progress, so the next one reads that row and
    not the manifest; a repeated batch replaces its frames and its row.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        have = spark.read.schema("captured bigint").parquet(f"{sink}-progress/batch={number - 1}").first()["captured"] if number else 0
        usable = batch.filter((F.col("frame_id") % stride == 0) & (F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) >= least))
        new = usable.orderBy("frame_id", "camera").limit(max(0, target - have)).select("camera", "frame_id", "face_id")
        new.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        added = spark.read.schema(new.schema).parquet(f"{sink}/batch={number}").count()
        spark.range(1).select(F.lit(have + added).cast("bigint").alias("captured")).write.mode("overwrite").parquet(f"{sink}-progress/batch={number}")

    return faces.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


PROGRESS = "query_id string, batch bigint, rows_in bigint, rows_late bigint, watermark string"


class ProgressLog(StreamingQueryListener):
    """Makes data of what streams tell: for each batch its rows, those that came later than the watermark allows, and the watermark.

    ``spark.streams.addListener(log)`` before a stream starts; :meth:`rows` after it. Only the last ``keep`` batches are held.
    """

    def __init__(self, keep: int = 10_000):
        self._held: deque[tuple] = deque(maxlen=keep)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        late = sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
        self._held.append((str(p.id), p.batchId, p.numInputRows, late, p.eventTime.get("watermark")))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def rows(self, spark: SparkSession, query_id: str | None = None) -> DataFrame:
        """query_id, batch, rows_in, rows_late, watermark."""
        return spark.createDataFrame([r for r in self._held if query_id in (None, r[0])], PROGRESS)
