"""Evaluation of spoof scores: error rates, ROC, EER, AUC, reports, strata and the fairness screen.

Input is ``scored(sample_id, attack_type, score, ...)``; ``by`` names grouping columns, so many models or
datasets are evaluated in one job. A score at or above the threshold is an attack. APCER is the share of
attacks below it, BPCER the share of bona fide at or above it.

Scale. All curves come from one histogram of (group, score), which partial aggregation builds. Running
sums over it never use an unpartitioned window: scores are dealt into buckets between fixed cut points,
bucket totals give each bucket its offset, and the running sum stays inside the bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presentia.plans.materialize import materialize, partitions_for

BONA_FIDE = "bona_fide"
# The kinds of presentation.
ATTACK_TYPES = ("bona_fide", "print", "replay", "cutout", "mask_3d")
MIN_BUCKET, MIN_GROUP, DISPARITY = 20, 50, 1.25
TARGETS = (0.01, 0.05, 0.10)


def is_attack(attack_type: Column) -> Column:
    """Everything that is not bona fide."""
    return attack_type != BONA_FIDE


def validate_scores(scored: DataFrame) -> DataFrame:
    """One row of violation counts: null, NaN or infinite, outside [0, 1], unknown type."""
    s = F.col("score").cast("double")
    odd = F.isnan(s) | s.isin(float("inf"), float("-inf"))
    return scored.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(s.isNull()).alias("n_null"),
        F.count_if(odd).alias("n_not_finite"),
        F.count_if(~odd & ((s < 0) | (s > 1))).alias("n_out_of_range"),
        F.count_if(F.col("attack_type").isNull() | ~F.col("attack_type").isin(*ATTACK_TYPES)).alias("n_unknown_type"),
    )


def require_valid_scores(scored: DataFrame) -> DataFrame:
    """``scored`` itself; raises if :func:`validate_scores` counts anything."""
    found = validate_scores(scored).first()
    bad = {k: v for k, v in found.asDict().items() if k != "n_rows" and v}
    if bad:
        raise ValueError(f"scores violate their contract: {bad}")
    return scored


def apcer_bpcer(scored: DataFrame, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """by, attack_type, n, rate: APCER for each attack type present, BPCER in the bona fide row."""
    wrong = F.when(is_attack(F.col("attack_type")), F.col("score") < threshold).otherwise(F.col("score") >= threshold)
    return scored.groupBy(*by, "attack_type").agg(F.count(F.lit(1)).alias("n"), F.avg(wrong.cast("double")).alias("rate"))


def operating_point(rates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, bpcer, worst_apcer, mean_apcer, acer from :func:`apcer_bpcer`; 0 where a class is missing."""
    attack = is_attack(F.col("attack_type"))
    point = rates.groupBy(*by).agg(
        F.coalesce(F.max(F.when(~attack, F.col("rate"))), F.lit(0.0)).alias("bpcer"),
        F.coalesce(F.max(F.when(attack, F.col("rate"))), F.lit(0.0)).alias("worst_apcer"),
        F.coalesce(F.avg(F.when(attack, F.col("rate"))), F.lit(0.0)).alias("mean_apcer"),
        F.coalesce(F.sum(F.when(~attack, F.col("n"))), F.lit(0)).alias("n_bona_fide"),
        F.coalesce(F.sum(F.when(attack, F.col("n"))), F.lit(0)).alias("n_attack"),
    )
    return point.withColumn("acer", (F.col("worst_apcer") + F.col("bpcer")) / 2)


#: Rows of a histogram whose running counts one window takes.
WINDOW_ROWS = 1 << 18


def prefix_counts(labelled: DataFrame, value: str, positive: Column, by: Sequence[str] = (), weight: Column | None = None, most: int | None = None, window_rows: int | None = None) -> DataFrame:
    """by, value, a, b, below_a, below_b, n_a, n_b: how many of each class stand at and below each distinct value.

    ``positive`` splits the rows into classes a and b; a row counts ``weight`` times. The histogram is written, so
    ``labelled`` is evaluated once, unless it is known to have ``most`` rows and these fit in one window. A larger
    histogram is cut into value ranges that grow in number with its rows; counts run inside a range, and a window
    over the ranges' totals, a row each, carries over what stands before it.
    """
    window_rows = WINDOW_ROWS if window_rows is None else window_rows
    one = F.lit(1) if weight is None else weight
    sums = [F.coalesce(F.sum(F.when(c, one)), F.lit(0)).cast("long").alias(n) for n, c in (("a", positive), ("b", ~positive))]
    hist = labelled.groupBy(*by, F.col(value).alias("value")).agg(*sums)
    if most is None or most > window_rows:
        hist = materialize(hist, "histogram")
        most = hist.count()
    keys, ranges = list(by), partitions_for(most, window_rows)
    if ranges > 1:
        # Written with the number of its range, so that no later task can see another one.
        hist = materialize(hist.repartitionByRange(ranges, "value").withColumn("range", F.spark_partition_id()), "ranges")
        keys.append("range")
    inside = Window.partitionBy(*(keys or [F.lit(0)]))
    below = inside.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    if ranges == 1:
        return hist.select(
            *by, "value", "a", "b", F.coalesce(F.sum("a").over(below), F.lit(0)).alias("below_a"), F.coalesce(F.sum("b").over(below), F.lit(0)).alias("below_b"),
            F.sum("a").over(inside).alias("n_a"), F.sum("b").over(inside).alias("n_b"),
        )
    group = Window.partitionBy(*(by or [F.lit(0)]))
    earlier = group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = hist.groupBy(*keys).agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    offsets = totals.select(
        *keys,
        F.coalesce(F.sum("ta").over(earlier), F.lit(0)).alias("oa"),
        F.coalesce(F.sum("tb").over(earlier), F.lit(0)).alias("ob"),
        F.sum("ta").over(group).alias("n_a"),
        F.sum("tb").over(group).alias("n_b"),
    )
    return hist.join(offsets, keys).select(
        *by, "value", "a", "b",
        (F.col("oa") + F.coalesce(F.sum("a").over(below), F.lit(0))).alias("below_a"),
        (F.col("ob") + F.coalesce(F.sum("b").over(below), F.lit(0))).alias("below_b"),
        "n_a", "n_b",
    )


def type_histogram(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, attack_type, score, n, written: all that the figures of a report need of the scores."""
    return materialize(scored.groupBy(*by, "attack_type", "score").agg(F.count(F.lit(1)).alias("n")), "scores")


def curve(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """:func:`prefix_counts` of the scores (or of their :func:`type_histogram`) with APCER and BPCER at each distinct score."""
    written = "n" in scored.columns
    counts = prefix_counts(scored, "score", is_attack(F.col("attack_type")), by, F.col("n") if written else None, scored.count() if written else None)
    return counts.withColumns(
        {
            "apcer": F.when(F.col("n_a") > 0, F.col("below_a") / F.col("n_a")).otherwise(0.0),
            "bpcer": F.when(F.col("n_b") > 0, (F.col("n_b") - F.col("below_b")) / F.col("n_b")).otherwise(0.0),
        }
    )


def roc(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, threshold, apcer, bpcer: every distinct score, minus infinity and infinity."""
    points = curve(scored, by)
    ends = points.groupBy(*by).agg(F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))
    low = ends.select(*by, F.lit(float("-inf")).alias("threshold"), F.lit(0.0).alias("apcer"), (F.col("n_b") > 0).cast("double").alias("bpcer"))
    high = ends.select(*by, F.lit(float("inf")).alias("threshold"), (F.col("n_a") > 0).cast("double").alias("apcer"), F.lit(0.0).alias("bpcer"))
    return points.select(*by, F.col("value").alias("threshold"), "apcer", "bpcer").unionByName(low).unionByName(high)


def eer_of(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, eer, eer_threshold from :func:`curve`; the lowest threshold on ties."""
    gap = F.abs(F.col("apcer") - F.col("bpcer"))
    best = points.groupBy(*by).agg(F.min(F.struct(gap.alias("gap"), F.col("value").alias("t"), ((F.col("apcer") + F.col("bpcer")) / 2).alias("rate"))).alias("m"))
    return best.select(*by, F.col("m.rate").alias("eer"), F.col("m.t").alias("eer_threshold"))


def auc_of(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, auc from :func:`curve`: Mann-Whitney with averaged ties; null if a class is missing."""
    area = F.sum(F.col("a") * (F.col("below_b") + F.col("b") / 2)) / (F.max("n_a").cast("double") * F.max("n_b"))
    return points.groupBy(*by).agg(F.when((F.max("n_a") > 0) & (F.max("n_b") > 0), area).alias("auc"))


def bpcer_at_apcer_of(points: DataFrame, target: float, by: Sequence[str] = ()) -> DataFrame:
    """by, target, bpcer, threshold, threshold_clamped: the lowest BPCER among thresholds whose APCER is within the target.

    Where infinity wins (no attacks, or target 1) the highest score stands for it and the flag is set.
    """
    if not 0 <= target <= 1:
        raise ValueError("a target APCER lies in [0, 1]")
    inside = points.filter(F.col("apcer") <= target)
    rows = inside.select(*by, F.struct("bpcer", F.col("value").alias("t"), F.lit(False).alias("clamped")).alias("m"))
    if target >= 1:
        top = points.groupBy(*by).agg(F.max("value").alias("t"))
        rows = rows.unionByName(top.select(*by, F.struct(F.lit(0.0).alias("bpcer"), F.col("t"), F.lit(True).alias("clamped")).alias("m")))
    best = rows.groupBy(*by).agg(F.min("m").alias("m"))
    return best.select(*by, F.lit(float(target)).alias("target"), F.col("m.bpcer").alias("bpcer"), F.col("m.t").alias("threshold"), F.col("m.clamped").alias("threshold_clamped"))


def _with(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join of one-row-for-each-group tables; without groups both have one row."""
    return a.join(b, list(by)) if by else a.join(F.broadcast(b))


def _rates_at(hist: DataFrame, thresholds: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, threshold, attack_type, n, rate from :func:`type_histogram`, at the thresholds (by, threshold)."""
    wrong = F.when(is_attack(F.col("attack_type")), F.col("score") < F.col("threshold")).otherwise(F.col("score") >= F.col("threshold"))
    joined = hist.join(thresholds, list(by)) if by else hist.join(F.broadcast(thresholds))
    return joined.groupBy(*by, "threshold", "attack_type").agg(F.sum("n").alias("n"), (F.sum(F.when(wrong, F.col("n")).otherwise(0)) / F.sum("n")).alias("rate"))


def require_both_classes(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``points`` of :func:`curve` itself; raises if a group lacks bona fide or attacks, naming the first few."""
    lacking = points.groupBy(*by).agg(F.max("n_a").alias("attacks"), F.max("n_b").alias("bona_fide")).filter(F.coalesce(F.least("attacks", "bona_fide"), F.lit(0)) == 0)
    found = lacking.limit(5).collect()
    if found:
        raise ValueError(f"a report needs bona fide and attack scores: {[r.asDict() for r in found]}")
    return points


def figures_of(points: DataFrame, targets: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by, eer, eer_threshold, auc and bpcer_at_<target> from :func:`curve`, in one pass over it."""
    if not all(0 <= t <= 1 for t in targets):
        raise ValueError("a target APCER lies in [0, 1]")
    gap = F.abs(F.col("apcer") - F.col("bpcer"))
    area = F.sum(F.col("a") * (F.col("below_b") + F.col("b") / 2)) / (F.max("n_a").cast("double") * F.max("n_b"))
    lowest = [(F.lit(0.0) if t >= 1 else F.min(F.when(F.col("apcer") <= t, F.col("bpcer")))).alias(f"bpcer_at_{t:.2f}".replace(".", "_")) for t in targets]
    out = points.groupBy(*by).agg(
        F.min(F.struct(gap.alias("gap"), F.col("value").alias("t"), ((F.col("apcer") + F.col("bpcer")) / 2).alias("rate"))).alias("m"),
        F.when((F.max("n_a") > 0) & (F.max("n_b") > 0), area).alias("auc"), *lowest,
    )
    return out.select(*by, F.col("m.rate").alias("eer"), F.col("m.t").alias("eer_threshold"), *[c for c in out.columns if c not in (*by, "m")])


def evaluate(scored: DataFrame, by: Sequence[str] = (), targets: Sequence[float] = TARGETS, thresholds: Sequence[float] | None = None) -> DataFrame:
    """One row for each group: counts, EER, AUC, BPCER at the targets, and the points at the thresholds.

    ``points`` is an array of structs ordered by threshold; without ``thresholds`` they are at 0.5 and at the
    rounded EER threshold, one entry if the two agree. Raises if a group lacks one of the classes. The scores are
    read once; every figure comes from their written histogram.
    """
    hist = type_histogram(scored, by)
    figures = figures_of(require_both_classes(materialize(curve(hist, by), "curve"), by), targets, by)
    wanted = F.array(F.round("eer_threshold", 6), F.lit(0.5)) if thresholds is None else F.array(*[F.lit(float(t)) for t in thresholds])
    chosen = figures.select(*by, F.explode(F.array_sort(F.array_distinct(wanted))).alias("threshold"))
    ops = operating_point(_rates_at(hist, chosen, by), [*by, "threshold"])
    packed = ops.groupBy(*by).agg(
        F.max("n_bona_fide").alias("n_bona_fide"), F.max("n_attack").alias("n_attack"),
        F.array_sort(F.collect_list(F.struct("threshold", "bpcer", "worst_apcer", "mean_apcer", "acer"))).alias("points"),
    )
    return _with(figures, packed, by)


def evaluate_at(scored: DataFrame, threshold: float, by: Sequence[str] = (), targets: Sequence[float] = TARGETS) -> DataFrame:
    """The report row at a given threshold, which is never refitted: rates there, EER, AUC and the targets.

    :func:`presentia.operators.reports.test_report` adds types, conditions and fairness.
    """
    return _report_at(type_histogram(scored, by), threshold, by, targets)


def _report_at(hist: DataFrame, threshold: float, by: Sequence[str], targets: Sequence[float]) -> DataFrame:
    """:func:`evaluate_at` of a written histogram."""
    here = hist.select(*by).distinct().withColumn("threshold", F.lit(float(threshold))) if by else hist.sparkSession.range(1).select(F.lit(float(threshold)).alias("threshold"))
    out = _with(operating_point(_rates_at(hist, here, by), by), figures_of(curve(hist, by), targets, by), by)
    return out.withColumn("threshold", F.lit(float(threshold)))


def slice_name(columns: Sequence[str]) -> Column:
    """The slice of a row by some columns: ``session=d0,device=null``; ``all`` by none."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in columns]
    return F.concat_ws(",", *parts) if parts else F.lit("all")


def evaluate_slices(scored: DataFrame, sets: Sequence[Sequence[str]], threshold: float, targets: Sequence[float] = TARGETS) -> DataFrame:
    """:func:`evaluate_at` for every slice of every set of columns (grouping sets), in one row each: ``slice`` and the report.

    The scores are counted once by all columns; the counts, not the scores, are expanded over the sets, and the
    curves of all slices are one job. A null value is a slice like others. A slice without attacks has APCER 0, one
    without bona fide BPCER 0, and neither has an AUC.
    """
    if not sets:
        raise ValueError("a set of columns is needed; an empty one stands for all rows")
    columns = sorted({c for s in sets for c in s})
    counts = scored.groupBy(*columns, "attack_type", "score").agg(F.count(F.lit(1)).alias("n"))
    wide = counts.select("attack_type", "score", "n", F.explode(F.array_distinct(F.array(*[slice_name(s) for s in sets]))).alias("slice"))
    hist = materialize(wide.groupBy("slice", "attack_type", "score").agg(F.sum("n").alias("n")), "slices")
    return _report_at(hist, threshold, ["slice"], targets)


def stratify(scored: DataFrame, threshold: float, min_n: int = MIN_BUCKET, by: Sequence[str] = ()) -> DataFrame:
    """by, axis, value, n, missed, apcer: attacks by capture condition; apcer is null under ``min_n``, ``attr:`` keys are skipped."""
    cond = scored.filter(is_attack(F.col("attack_type"))).select(*by, "score", F.explode("conditions").alias("axis", "value")).filter(~F.col("axis").startswith("attr:"))
    out = cond.groupBy(*by, "axis", "value").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") < threshold).alias("missed"))
    return out.withColumn("apcer", F.when(F.col("n") >= min_n, F.col("missed") / F.col("n")))


def fairness_groups(scored: DataFrame, threshold: float, min_n: int = MIN_GROUP, by: Sequence[str] = ()) -> DataFrame:
    """by, attribute, value, n, rejected, bpcer: bona fide by attribute of the person."""
    attr = scored.filter(~is_attack(F.col("attack_type"))).select(*by, "score", F.explode("conditions").alias("k", "value"))
    attr = attr.filter(F.col("k").startswith("attr:") & (F.length("k") > 5)).withColumn("attribute", F.substring("k", 6, 1000))
    out = attr.groupBy(*by, "attribute", "value").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") >= threshold).alias("rejected"))
    return out.withColumn("bpcer", F.when(F.col("n") >= min_n, F.col("rejected") / F.col("n")))


def fairness_audit(groups: DataFrame, disparity: float = DISPARITY, by: Sequence[str] = ()) -> DataFrame:
    """by, attribute, rated, worst, best, ratio, gap, flagged; the last four are null with fewer than two rated groups."""
    out = groups.groupBy(*by, "attribute").agg(F.count("bpcer").alias("rated"), F.max("bpcer").alias("worst"), F.min("bpcer").alias("best"))
    two = F.col("rated") >= 2
    ratio = F.when(two & (F.col("best") > 0), F.col("worst") / F.when(F.col("best") > 0, F.col("best")))
    flagged = F.coalesce(ratio >= disparity, F.lit(False)) | ((F.col("best") == 0) & (F.col("worst") > 0))
    return out.withColumns({"ratio": ratio, "gap": F.when(two, F.col("worst") - F.col("best")), "flagged": F.when(two, flagged)})


def join_scores(manifest: DataFrame, scores: DataFrame, key: str = "sample_id") -> DataFrame:
    """Samples with their scores. Raises if an id is missing on either side or stands twice: never shifted silently."""
    m, s = manifest.groupBy(key).agg(F.count(F.lit(1)).alias("m")), scores.groupBy(key).agg(F.count(F.lit(1)).alias("s"))
    found = coverage(m, s, key).first()
    if found["missing"] or found["unknown"] or found["repeated"]:
        raise ValueError(f"scores do not cover the manifest: {found.asDict()}")
    return manifest.join(scores, key)


def coverage(m: DataFrame, s: DataFrame, key: str) -> DataFrame:
    """One row: ids without a score, scores without a sample, ids that stand twice. ``m`` and ``s``: key and count."""
    return m.join(s, key, "full").agg(F.count_if(F.col("s").isNull()).alias("missing"), F.count_if(F.col("m").isNull()).alias("unknown"), F.count_if((F.col("m") > 1) | (F.col("s") > 1)).alias("repeated"))


def pair_scores(expected: DataFrame, actual: DataFrame, key: str = "sample_id", value: str = "score") -> DataFrame:
    """key, expected, actual from two tables of scores or of arrays of logits. Raises if an id is missing, stands twice, or lengths differ."""
    e, a = expected.select(key, F.col(value).alias("expected")), actual.select(key, F.col(value).alias("actual"))
    found = coverage(e.groupBy(key).agg(F.count(F.lit(1)).alias("m")), a.groupBy(key).agg(F.count(F.lit(1)).alias("s")), key).first()
    if any(found):
        raise ValueError(f"the two tables do not cover each other: {found.asDict()}")
    pairs = e.join(a, key)
    if str(pairs.schema["expected"].dataType.typeName()) == "array":
        wrong = pairs.filter(F.size("expected") != F.size("actual")).count()
        if wrong:
            raise ValueError(f"{wrong} rows differ in length")
    return pairs


def verify_scores(pairs: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """One row: n, missing, max_abs_diff, passed, of (sample_id, expected, actual); both scores, or arrays of logits."""
    one = F.abs(F.col("expected") - F.col("actual"))
    if str(pairs.schema["expected"].dataType.typeName()) == "array":
        one = F.array_max(F.zip_with("expected", "actual", lambda x, y: F.abs(x - y)))
    missing = F.count_if(F.col("expected").isNull() | F.col("actual").isNull())
    return pairs.agg(F.count(F.lit(1)).alias("n"), missing.alias("missing"), F.max(one).alias("max_abs_diff")).withColumn(
        "passed", (F.col("missing") == 0) & F.coalesce(F.col("max_abs_diff") <= tolerance, F.lit(True))
    )


def require_equal_scores(expected: DataFrame, actual: DataFrame, tolerance: float = 1e-4, key: str = "sample_id", value: str = "score") -> DataFrame:
    """The row of :func:`verify_scores`; raises if the tables do not match within the tolerance."""
    out = verify_scores(pair_scores(expected, actual, key, value), tolerance)
    row = out.first()
    if not row["passed"]:
        raise ValueError(f"scores differ by {row['max_abs_diff']}, allowed is {tolerance}")
    return out


#: The metrics two datasets are compared by; for the first a higher value is better.
COMPARED = ("auc", "eer", "worst_apcer", "bpcer", "acer")


def cross_dataset(source: DataFrame, target: DataFrame) -> DataFrame:
    """metric, source, target, delta, direction (better, worse, =), verdict; both sides one row of rates."""
    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in COMPARED]))
        return df.select(pairs.alias("p")).select("p.metric", f"p.{name}")

    both = long(source, "source").join(long(target, "target"), "metric").withColumn("delta", F.col("target") - F.col("source"))
    gap = {m: F.coalesce(F.max(F.when(F.col("metric") == m, F.coalesce("target", F.lit(0.0)) - F.coalesce("source", F.lit(0.0)))), F.lit(0.0)) for m in COMPARED}
    verdict = both.agg(
        F.when(gap["eer"] > 0.10, "discrimination_collapse")
        .when(F.greatest(gap["worst_apcer"], gap["bpcer"]) > 0.10, "threshold_did_not_transfer")
        .when((gap["eer"] > 0.03) | (F.greatest(gap["worst_apcer"], gap["bpcer"]) > 0.03), "moderate")
        .otherwise("small")
        .alias("verdict")
    )
    better = F.when(F.col("metric") == "auc", F.col("delta") > 0).otherwise(F.col("delta") < 0)
    return both.withColumn("direction", F.when(F.abs("delta") < 1e-9, "=").when(better, "better").otherwise("worse")).join(F.broadcast(verdict))
