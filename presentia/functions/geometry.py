"""Columns of boxes, detections and landmarks. A box is x1, y1, x2, y2 with its corners in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CROP_SIZE, MARGIN = 112, 0.30
LEAST_SCORE, LEAST_SIDE = 0.5, 2
# Landmark positions in a crop of 112 pixels.
TEMPLATE = ((38.2946, 51.6963), (73.5318, 51.5014), (56.0252, 71.7366), (41.5493, 92.3655), (70.7299, 92.2041))


def c(name: str) -> Column:
    return F.col(name)


def box_metrics(boxes: DataFrame) -> DataFrame:
    """Adds width, height, area."""
    return boxes.withColumns({"width": c("x2") - c("x1"), "height": c("y2") - c("y1"), "area": (c("x2") - c("x1")) * (c("y2") - c("y1"))})


def box_valid() -> Column:
    """Corners in order and a score in [0, 1]; null parts are not valid."""
    return F.coalesce((c("x2") > c("x1")) & (c("y2") > c("y1")) & c("score").between(0, 1), F.lit(False))


def box_scaled(boxes: DataFrame, fx: float, fy: float) -> DataFrame:
    """Corners times the factors, truncated, at least one pixel wide and high."""
    x1, y1 = (c("x1") * fx).cast("int"), (c("y1") * fy).cast("int")
    return boxes.withColumns({"x1": x1, "y1": y1, "x2": F.greatest((c("x2") * fx).cast("int"), x1 + 1), "y2": F.greatest((c("y2") * fy).cast("int"), y1 + 1)})


def box_clipped(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Corners inside the image, which keeps a pixel of the box."""
    def clamp(name: str, lo: int, hi: int) -> Column:
        return F.least(F.greatest(c(name), F.lit(lo)), F.lit(hi))

    return boxes.withColumns({"x1": clamp("x1", 0, width - 2), "y1": clamp("y1", 0, height - 2), "x2": clamp("x2", 1, width - 1), "y2": clamp("y2", 1, height - 1)})


def crop_window(boxes: DataFrame, width: int, height: int, margin: float = MARGIN) -> DataFrame:
    """Adds cx1, cy1, cx2, cy2 (the box with a margin, inside the image) and empty."""
    mx, my = ((c("x2") - c("x1")) * margin).cast("int"), ((c("y2") - c("y1")) * margin).cast("int")
    out = boxes.withColumns(
        {"cx1": F.greatest(c("x1") - mx, F.lit(0)), "cy1": F.greatest(c("y1") - my, F.lit(0)), "cx2": F.least(c("x2") + mx, F.lit(width)), "cy2": F.least(c("y2") + my, F.lit(height))}
    )
    return out.withColumn("empty", (c("cx2") <= c("cx1")) | (c("cy2") <= c("cy1")))


def decode_detections(cands: DataFrame, scale: float = 1.0, least: float = LEAST_SCORE) -> DataFrame:
    """Edge distances in strides around anchor centres to corners in image pixels; candidates under ``least`` go.

    ``cands``: stride, gx, gy, score, l, t, r, b and optionally kps array<struct<x, y>>.
    """
    cx, cy, s = c("gx") * c("stride"), c("gy") * c("stride"), c("stride")
    out = cands.filter(c("score") >= least).withColumns(
        {"x1": (cx - c("l") * s) / scale, "y1": (cy - c("t") * s) / scale, "x2": (cx + c("r") * s) / scale, "y2": (cy + c("b") * s) / scale}
    )
    if "kps" in cands.columns:
        out = out.withColumn("kps", F.transform("kps", lambda p: F.struct(((p["x"] * s + cx) / scale).alias("x"), ((p["y"] * s + cy) / scale).alias("y"))))
    return out


def finalize_detections(dets: DataFrame, width: int, height: int) -> DataFrame:
    """Drops boxes under two pixels, truncates corners, clips score and box."""
    kept = dets.filter((c("x2") - c("x1") >= LEAST_SIDE) & (c("y2") - c("y1") >= LEAST_SIDE))
    whole = kept.withColumns({k: c(k).cast("int") for k in ("x1", "y1", "x2", "y2")} | {"score": F.least(F.greatest(c("score"), F.lit(0.0)), F.lit(1.0))})
    return box_clipped(whole, width, height)


def alignment_params(kps: Column, size: int = CROP_SIZE) -> Column:
    """struct p, q, tx, ty: the least-squares similarity [[p, -q], [q, p]] from five landmarks to the template.

    Closed form over centred points; identical landmarks give scale 1 and no rotation. Null unless there are
    five finite points.
    """
    k = size / CROP_SIZE
    target = F.array(*[F.struct(F.lit(x * k).alias("x"), F.lit(y * k).alias("y")) for x, y in TEMPLATE])
    n = float(len(TEMPLATE))

    def total(array: Column, f) -> Column:
        return F.aggregate(array, F.lit(0.0), lambda s, e: s + f(e))

    sx, sy = total(kps, lambda e: e["x"].cast("double")) / n, total(kps, lambda e: e["y"].cast("double")) / n
    tx, ty = sum(x for x, _ in TEMPLATE) * k / n, sum(y for _, y in TEMPLATE) * k / n
    pairs = F.zip_with(kps, target, lambda a, b: F.struct((a["x"] - sx).alias("ax"), (a["y"] - sy).alias("ay"), (b["x"] - tx).alias("bx"), (b["y"] - ty).alias("by")))
    var = total(pairs, lambda e: e["ax"] * e["ax"] + e["ay"] * e["ay"])
    dot, cross = total(pairs, lambda e: e["ax"] * e["bx"] + e["ay"] * e["by"]), total(pairs, lambda e: e["ax"] * e["by"] - e["ay"] * e["bx"])
    flat = var / n < 1e-12
    p, q = F.when(flat, 1.0).otherwise(dot / var), F.when(flat, 0.0).otherwise(cross / var)
    fine = (F.size(kps) == len(TEMPLATE)) & F.forall(kps, lambda e: F.coalesce(F.abs(e["x"].cast("double")) + F.abs(e["y"].cast("double")) < float("inf"), F.lit(False)))
    return F.when(fine, F.struct(p.alias("p"), q.alias("q"), (F.lit(tx) - (p * sx - q * sy)).alias("tx"), (F.lit(ty) - (q * sx + p * sy)).alias("ty")))


def augmentation_plan(samples: DataFrame, epochs: int, seed: int, key: str = "path", image_size: int = CROP_SIZE) -> DataFrame:
    """key, epoch and the draws of each sample in each epoch: flip, contrast, brightness, angle, shift_x, shift_y, jpeg_quality, blur.

    A draw depends on seed, epoch, key and slot only, so any number of workers makes the same plan. Null
    stands for a step not taken.
    """
    rows = samples.select(key, F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))

    def u(slot: str) -> Column:
        text = F.concat_ws(":", F.lit(str(seed)), c("epoch").cast("string"), c(key), F.lit(slot))
        return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)

    tone, turn = u("tone") < 0.7, u("turn") < 0.5
    return rows.select(
        key, "epoch", (u("flip") < 0.5).alias("flip"),
        F.when(tone, 1.0 + 0.4 * u("contrast") - 0.2).alias("contrast"), F.when(tone, 40 * u("brightness") - 20).alias("brightness"),
        F.when(turn, 16 * u("angle") - 8).alias("angle"), F.when(turn, (0.08 * u("shift_x") - 0.04) * image_size).alias("shift_x"), F.when(turn, (0.08 * u("shift_y") - 0.04) * image_size).alias("shift_y"),
        F.when(u("jpeg") < 0.3, F.floor(45 + 50 * u("quality"))).alias("jpeg_quality"), (u("blur") < 0.15).alias("blur"),
    )
