"""Thresholds, verdicts, trust and enrolment gates, recognition behind the gate, latency statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presentia.operators.evaluation import prefix_counts
from presentia.operators.galleries import THRESHOLD, identify
from presentia.plans.materialize import materialize

DEFAULT_THRESHOLD = 0.5
LEAST_ENROLL_FACE, LEAST_SHARPNESS = 110, 40.0


def resolve_threshold(override: Column, stored: Column) -> tuple[Column, Column]:
    """The threshold and where it comes from: override, stored validation value, default."""
    value = F.coalesce(override, stored, F.lit(DEFAULT_THRESHOLD))
    return value, F.when(override.isNotNull(), "override").when(stored.isNotNull(), "validation").otherwise("default")


def is_live(p: Column, threshold: float | Column) -> Column:
    """Under the threshold; null stays null: never checked."""
    return p < (threshold if isinstance(threshold, Column) else F.lit(threshold))


def trust_status(live: Column, name: Column) -> Column:
    """SPOOF before anything else; UNVERIFIED without a check; TRUSTED only if live and named."""
    return F.when(~live, "SPOOF").when(live.isNull(), "UNVERIFIED").when(name.isNotNull(), "TRUSTED").otherwise("UNKNOWN")


HINTS = {
    "TRUSTED": "enrolled person, passed the liveness check",
    "SPOOF": "liveness check failed, so no identity was looked up",
    "UNKNOWN": "passed the liveness check, matches nobody in the gallery",
    "UNVERIFIED": "no liveness check took place, treat as a possible picture",
}


def hint(status: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in HINTS.items() for x in kv]), status)


def enroll_reject_reason(width: int, height: int, threshold: float, require_live: bool = True) -> Column:
    """The first reason not to enrol a face row; null for a good one."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    outside = (F.col("x1") >= width) | (F.col("y1") >= height) | (F.col("x2") <= 0) | (F.col("y2") <= 0)
    rejected = F.lit(require_live) & F.coalesce(F.col("spoof_probability") >= threshold, F.lit(False))
    return (
        F.when(F.col("x1").isNull(), "no_face").when(F.least(w, h) < LEAST_ENROLL_FACE, "too_small").when(outside, "out_of_frame")
        .when(F.col("sharpness") < LEAST_SHARPNESS, "too_blurry").when(rejected, "liveness_rejected")
    )


def enroll_guard(faces: DataFrame, by: Sequence[str], threshold: float, require_liveness: bool = True) -> DataFrame:
    """by, faces, reason of each frame: exactly one face, live (null fails), with an embedding, in this order."""
    frames = faces.groupBy(*by).agg(F.count("face_id").alias("faces"), F.max("spoof_probability").alias("p"), F.max("vec_id").alias("vec_id"))
    live = F.coalesce(F.col("p") < threshold, F.lit(False)) | F.lit(not require_liveness)
    reason = F.when(F.col("faces") == 0, "no_face").when(F.col("faces") > 1, "several_faces").when(~live, "not_live").when(F.col("vec_id").isNull(), "no_embedding")
    return frames.select(*by, "faces", reason.alias("reason"))


def recognize(faces: DataFrame, embeddings: DataFrame, gallery: DataFrame, threshold: float, match: float = THRESHOLD, identify_spoofs: bool = False, require_liveness: bool = True) -> DataFrame:
    """Every face with name and similarity; only embeddings of faces that pass the gate reach the matching.

    Rejected faces have a null identity. With an empty gallery every identity is null. ``faces`` must have a
    spoof_probability column unless ``require_liveness`` is off; then none is verified. An embedding is matched once,
    however many faces have it; what it was found to be is written and joined to the faces by ``vec_id``, so no vector
    is copied to a face and small results are broadcast without a shuffle of the faces.
    """
    if "spoof_probability" not in faces.columns:
        if require_liveness:
            raise ValueError("a gate needs a liveness column")
        faces = faces.withColumn("spoof_probability", F.lit(None).cast("double"))
    live = is_live(F.col("spoof_probability"), threshold)
    passes = F.lit(identify_spoofs) | live.isNull() | live
    asked = faces.filter(passes).select("vec_id").distinct()
    probes = embeddings.join(asked, "vec_id", "left_semi").select(F.col("vec_id").alias("probe_id"), "v")
    found = materialize(identify(probes, gallery, match).filter(~F.col("database_empty")), "recognized")
    named = found.select(F.col("probe_id").alias("vec_id"), F.col("name").alias("name_"), F.col("similarity").alias("similarity_"))
    out = faces.join(named, "vec_id", "left").select(*[faces[c] for c in faces.columns], F.when(passes, F.col("name_")).alias("name"), F.when(passes, F.col("similarity_")).alias("similarity"))
    return out.withColumn("is_live", live).withColumn("status", trust_status(F.col("is_live"), F.col("name")))


def frame_summary(faces: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, faces, trusted, spoofs, total_ms, fps; faces carry the frame's stage times."""
    out = faces.groupBy(*by).agg(
        F.count("face_id").alias("faces"), F.count_if(F.col("status") == "TRUSTED").alias("trusted"), F.count_if(F.col("status") == "SPOOF").alias("spoofs"),
        F.max(F.col("detect_ms") + F.col("liveness_ms") + F.col("recognize_ms")).alias("total_ms"),
    )
    return out.withColumn("fps", F.when(F.col("total_ms") > 0, 1000 / F.col("total_ms")).otherwise(0.0))


def drop_warmup(runs: DataFrame, k: int, by: Sequence[str]) -> DataFrame:
    """The runs of each group without the first ``k``, by run number.

    The first ``k`` numbers are a top-k that every task cuts before the shuffle; nothing else is sorted. Runs that
    share the number of a warm-up run are warm-up runs too.
    """
    first = runs.select(*by, "run").withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("run"))).filter(F.col("nth") <= k)
    ends = first.groupBy(*by).agg(F.max("run").alias("warm_until"))
    return runs.join(ends, list(by), "left").filter(F.col("warm_until").isNull() | (F.col("run") > F.col("warm_until"))).select(*runs.columns)


def latency_stats(runs: DataFrame, k: int, by: Sequence[str] = ("stage", "batch")) -> DataFrame:
    """by, n, median, p95, min, max, mean, fps, per_item after the warm-up.

    Percentiles interpolate between the ranks around them, found in running counts over a histogram.
    """
    points = prefix_counts(drop_warmup(runs, k, by), "ms", F.lit(True), by)
    ranks = {"median": 0.5, "p95": 0.95}
    found = []
    for name, share in ranks.items():
        at = F.lit(share) * (F.col("n_a") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            found.append(F.max(F.when((F.col("below_a") <= rank) & (rank < F.col("below_a") + F.col("a")), F.col("value"))).alias(f"{name}_{side}"))
    out = points.groupBy(*by).agg(
        F.max("n_a").alias("n"), *found, F.min("value").alias("min"), F.max("value").alias("max"), (F.sum(F.col("value") * F.col("a")) / F.max("n_a")).alias("mean")
    )
    for name, share in ranks.items():
        at = F.lit(share) * (F.col("n") - 1)
        out = out.withColumn(name, F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * (at - F.floor(at)))
    out = out.select(*by, "n", "median", "p95", "min", "max", "mean")
    return out.withColumns({"fps": F.when(F.col("median") > 0, 1000 / F.col("median")).otherwise(0.0), "per_item": F.col("median") / F.col("batch")})


def end_to_end(stats: DataFrame, stages: Sequence[str], by: Sequence[str] = ("batch",)) -> DataFrame:
    """by, total_ms, fps, missing: the sum of the stages' medians and which stages have none."""
    out = stats.filter(F.col("stage").isin(*stages)).groupBy(*by).agg(F.sum("median").alias("total_ms"), F.collect_set("stage").alias("have"))
    gone = F.array_join(F.array_sort(F.array_except(F.array(*[F.lit(s) for s in stages]), F.col("have"))), ",")
    return out.select(*by, "total_ms", F.when(F.col("total_ms") > 0, 1000 / F.col("total_ms")).otherwise(0.0).alias("fps"), gone.alias("missing"))
