"""Detection candidates and frames: suppression, largest face, capture, thinning, history, frame rates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NMS_IOU = 0.4
#: Kept boxes of an image that are compared one by one.
FEW_BOXES = 32
CELL, HISTORY = 120, 120
STRIDE, LEAST_FACE, MIN_GAP, TARGET = 3, 80, 12, 8


class Kept:
    """The boxes kept in an image, found again by where they are and how large.

    Boxes that overlap by more than ``iou`` have sides of a ratio over ``iou`` and centres less than a side apart. A
    box lies in the cell of its centre, in a grid of its level: levels grow by ``1 / iou`` and a cell has the longest
    side of its level, so what can suppress a box is in the cells around it on three levels.
    """

    def __init__(self, iou: float):
        self.iou, self.scale = iou, -math.log(iou) if 0 < iou < 1 else 0.0
        self.few: list[tuple] = []  # as long as there are few, and boxes that have no size
        self.cells: dict[tuple[int, int, int], list[tuple]] | None = None

    def _place(self, box: tuple) -> tuple[int, float, float]:
        x1, y1, x2, y2 = box
        return math.floor(math.log(max(x2 - x1, y2 - y1) + 1) / self.scale), (x1 + x2) / 2, (y1 + y2) / 2

    def _side(self, level: int) -> float:
        return math.exp(self.scale * (level + 1))

    def _cell(self, box: tuple) -> tuple[int, int, int]:
        level, x, y = self._place(box)
        return level, math.floor(x / self._side(level)), math.floor(y / self._side(level))

    def _hits(self, box: tuple, others: list[tuple]) -> bool:
        x1, y1, x2, y2 = box
        own = (x2 - x1 + 1) * (y2 - y1 + 1)
        for a1, b1, a2, b2 in others:
            w, h = min(x2, a2) - max(x1, a1) + 1, min(y2, b2) - max(y1, b1) + 1
            inter = w * h if w > 0 and h > 0 else 0
            union = own + (a2 - a1 + 1) * (b2 - b1 + 1) - inter
            if union and inter / union > self.iou:
                return True
        return False

    def takes(self, box: tuple) -> bool:
        """Whether no kept box suppresses ``box``; it is kept then. A box that lacks a corner is kept and suppresses none."""
        if None in box:
            return True
        if self._hits(box, self.few):
            return False
        sized = self.scale and box[2] >= box[0] and box[3] >= box[1]
        if self.cells is not None:
            if not sized:
                if any(self._hits(box, c) for c in self.cells.values()):
                    return False
            else:
                level, x, y = self._place(box)
                own = self._side(level)
                for k in (level, level + 1, level - 1):
                    side = self._side(k)
                    reach, cx, cy = math.ceil(max(own, side) / side), math.floor(x / side), math.floor(y / side)
                    for i in range(cx - reach, cx + reach + 1):
                        for j in range(cy - reach, cy + reach + 1):
                            if (there := self.cells.get((k, i, j))) and self._hits(box, there):
                                return False
        if self.cells is None or not sized:
            self.few.append(box)
        else:
            self.cells.setdefault(self._cell(box), []).append(box)
        if self.cells is None and self.scale and len(self.few) > FEW_BOXES:
            self.cells, odd = {}, []
            for b in self.few:
                if b[2] >= b[0] and b[3] >= b[1]:
                    self.cells.setdefault(self._cell(b), []).append(b)
                else:
                    odd.append(b)
            self.few = odd
        return True


def nms(cands: DataFrame, iou: float = NMS_IOU) -> DataFrame:
    """Greedy non-maximum suppression in each image: by score, candidate id on ties.

    The candidates of an image stream through one task in that order; what is held are the boxes kept, in a grid.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image, kept = None, Kept(iou)
        for b in batches:
            mask = []
            for at, *box in zip(*(b.column(c).to_pylist() for c in ("image_id", "x1", "y1", "x2", "y2")), strict=True):
                if at != image:
                    image, kept = at, Kept(iou)
                mask.append(kept.takes(tuple(box)))
            yield b.filter(pa.array(mask, pa.bool_()))

    rows = cands.select("image_id", "cand_id", "x1", "y1", "x2", "y2", "score")
    return rows.repartition("image_id").sortWithinPartitions("image_id", F.desc_nulls_first("score"), "cand_id").mapInArrow(run, rows.schema)


def largest_face(faces: DataFrame, by: list[str]) -> DataFrame:
    """The face with the biggest area in each frame, the smallest id on ties."""
    area = (F.col("x2") - F.col("x1")).cast("long") * (F.col("y2") - F.col("y1"))
    best = faces.groupBy(*by).agg(F.max_by(F.struct("face_id", area.alias("area")), F.struct(area, -F.col("face_id"))).alias("m"))
    return best.select(*by, "m.face_id", "m.area")


def capture_frames(dets: DataFrame, frame: str = "image_id", stride: int = STRIDE, target: int = 100, least: int = LEAST_FACE, already: int = 0) -> DataFrame:
    """frame, boxes, reason, number: frames with one box of ``least`` pixels on both sides at every ``stride``-th index.

    The first ``target`` usable frames are accepted (reason null) and numbered on from ``already``.
    """
    side = F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    frames = dets.groupBy(frame).agg(F.count(F.lit(1)).alias("boxes"), F.min(side).alias("side"))
    reason = F.when(F.col("boxes") > 1, "several_faces").when(F.col("side") < least, "too_small").when(F.col(frame) % stride != 0, "between_strides")
    judged = frames.withColumn("reason", reason)
    # The first `target` by index are a bounded top-k; the rest of the usable frames come after it.
    first = judged.filter("reason is null").orderBy(frame).limit(target)
    numbered = first.select(frame, (F.row_number().over(Window.orderBy(frame)) + already).alias("number"))
    return judged.join(F.broadcast(numbered), frame, "left").select(
        frame, "boxes", F.when(F.col("reason").isNull() & F.col("number").isNull(), "target_reached").otherwise(F.col("reason")).alias("reason"), "number"
    )


def thin_frames(frames: DataFrame, by: list[str], frame: str = "frame_id", min_gap: int = MIN_GAP, target: int = TARGET) -> DataFrame:
    """by, frame: greedy choice of usable frames at least ``min_gap`` after the last chosen one, until ``target``.

    The frames of a key stream through one task in order; what is held is the last chosen frame and a count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, chosen = None, 0, 0
        for b in batches:
            keep = []
            for here, at in zip(zip(*(b.column(c).to_pylist() for c in by), strict=True), b.column(frame).to_pylist(), strict=True):
                if here != key:
                    key, chosen = here, 0
                take = chosen < target and (chosen == 0 or at - last >= min_gap)
                if take:
                    last, chosen = at, chosen + 1
                keep.append(take)
            yield b.filter(pa.array(keep, pa.bool_()))

    rows = frames.filter(F.col(frame).isNotNull()).select(*by, F.col(frame).cast("long").alias(frame))
    return rows.repartition(*by).sortWithinPartitions(*by, frame).mapInArrow(run, rows.schema)


def with_cells(faces: DataFrame, cell: int = CELL) -> DataFrame:
    """Adds cell_x, cell_y: the grid cell of the box centre."""
    return faces.withColumns({"cell_x": F.floor((F.col("x1") + F.col("x2")) / 2 / cell).cast("int"), "cell_y": F.floor((F.col("y1") + F.col("y2")) / 2 / cell).cast("int")})


#: Ticks in a bucket of a camera's history.
TICKS = 1 << 18


def with_ticks(rows: DataFrame, by: str, order: list[str], width: int = TICKS) -> DataFrame:
    """Adds tick: the place of a row of ``by`` in the order, from 1. The first column of the order is a whole number.

    Rows are numbered inside buckets of that number; a window over the few buckets gives each its offset. What all
    lies in one bucket needs none.
    """
    lo, hi = rows.agg(F.min(order[0]), F.max(order[0])).first()
    if lo is None or hi // width == lo // width:
        return rows.withColumn("tick", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long"))
    bucketed = rows.withColumn("bucket_", F.floor(F.col(order[0]) / width))
    counts = bucketed.groupBy(by, "bucket_").agg(F.count(F.lit(1)).alias("rows_"))
    before = Window.partitionBy(by).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(by, "bucket_", F.coalesce(F.sum("rows_").over(before), F.lit(0)).alias("offset_"))
    inside = Window.partitionBy(by, "bucket_").orderBy(*order)
    return bucketed.withColumn("nth_", F.row_number().over(inside)).join(offsets, [by, "bucket_"]).withColumn("tick", F.col("nth_") + F.col("offset_")).drop("bucket_", "nth_", "offset_", "rows_")


def _overlapping(ticked: DataFrame, reach: int, width: int) -> DataFrame:
    """Rows in their ``span`` of ticks, and those of the last ``reach`` ticks also in the next one, where ``own`` is false."""
    span = F.floor(F.col("tick") / width)
    own = ticked.withColumns({"span": span, "own": F.lit(True)})
    late = ticked.filter(F.col("tick") % width >= width - reach).withColumns({"span": span + 1, "own": F.lit(False)})
    return own.unionByName(late)


def score_history(faces: DataFrame, cell: int = CELL, n: int = HISTORY, width: int = TICKS) -> DataFrame:
    """face_id, camera, cell, tick, n and mean of the last ``n`` scores of its cell, restarted where the cell was unseen too long.

    Ticks count a camera's scored faces. A series restarts after a gap of more than n + 1 ticks, so the last n of a
    series lie within n * (n + 1) ticks: histories are cut into spans of ``width`` ticks that see so much of the
    span before, and no camera or cell has to pass through one task.
    """
    reach = n * (n + 1)
    if width <= reach:
        raise ValueError("a span must be longer than what it sees of the one before")
    scored = with_cells(faces.filter("spoof_probability is not null"), cell).select("face_id", "camera", "cell_x", "cell_y", "frame_id", "spoof_probability")
    spans = _overlapping(with_ticks(scored, "camera", ["frame_id", "face_id"]), reach, width)
    where = ["camera", "cell_x", "cell_y", "span"]
    series = Window.partitionBy(*where).orderBy("tick")
    cut = F.coalesce((F.col("tick") - F.lag("tick").over(series) > n + 1).cast("int"), F.lit(0))
    runs = spans.withColumn("restart", cut).withColumn("run", F.sum("restart").over(series))
    last = Window.partitionBy(*where, "run").orderBy("tick").rowsBetween(-(n - 1), 0)
    out = runs.select("face_id", "camera", "cell_x", "cell_y", "tick", F.count(F.lit(1)).over(last).alias("n"), F.avg("spoof_probability").over(last).alias("mean_score"), "own")
    return out.filter("own").drop("own")


def rolling_fps(frames: DataFrame, n: int = 30, width: int = TICKS) -> DataFrame:
    """camera, frame_id, fps over the last ``n`` frames; ``frames`` has total_ms. Spans see the last n - 1 frames of the one before."""
    spans = _overlapping(with_ticks(frames.select("camera", "frame_id", "total_ms"), "camera", ["frame_id"]), n - 1, width)
    last = Window.partitionBy("camera", "span").orderBy("tick").rowsBetween(-(n - 1), 0)
    seconds = F.sum("total_ms").over(last) / 1000
    out = spans.select("camera", "frame_id", F.when(seconds > 0, F.count(F.lit(1)).over(last) / seconds).otherwise(0.0).alias("fps"), "own")
    return out.filter("own").drop("own")
