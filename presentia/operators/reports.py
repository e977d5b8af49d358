"""Tidy, ordered rows of an evaluation: what a person reads, without the layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presentia.operators.evaluation import TARGETS, apcer_bpcer, evaluate_at, fairness_audit, fairness_groups, is_attack, stratify

SMALL_SAMPLE = 200
SKIN_TONE_ATTRIBUTE = "Pale_Skin"


def type_rows(rates: DataFrame) -> DataFrame:
    """pos, attack_type, n, apcer, weakest: attack types by APCER, highest first; a weakest one only if they differ."""
    attacks = rates.filter(is_attack(F.col("attack_type")))
    bounds = attacks.agg(F.max("rate").alias("hi"), F.min("rate").alias("lo"))
    order = Window.orderBy(F.desc("rate"), "attack_type")  # one row for each attack type
    return attacks.join(F.broadcast(bounds)).select(
        F.row_number().over(order).cast("long").alias("pos"), "attack_type", "n", F.col("rate").alias("apcer"), ((F.col("hi") > F.col("lo")) & (F.col("rate") == F.col("hi"))).alias("weakest")
    )


def condition_rows(strata: DataFrame) -> DataFrame:
    """pos, axis, value, n, apcer: by axis, worst value first, unrated ones last."""
    order = Window.partitionBy("axis").orderBy(F.col("apcer").isNull(), F.desc("apcer"), "value")
    return strata.select(F.row_number().over(order).cast("long").alias("pos"), "axis", "value", "n", "apcer")


def fairness_rows(audit: DataFrame) -> DataFrame:
    """pos, attribute, ratio, flagged, note, caveat: flagged attributes first, then by ratio."""
    flagged = F.coalesce("flagged", F.lit(False))
    order = Window.orderBy(F.desc(flagged), F.desc(F.coalesce("ratio", F.lit(0.0))), "attribute")  # one row for each attribute
    note = F.when(~flagged, "").when(F.col("ratio").isNull(), "best group without errors").otherwise(F.format_string("worst group %.2f times the best", "ratio"))
    return audit.select(F.row_number().over(order).cast("long").alias("pos"), "attribute", "ratio", flagged.alias("flagged"), note.alias("note"), (F.col("attribute") == SKIN_TONE_ATTRIBUTE).alias("caveat"))


def headline(report: DataFrame) -> DataFrame:
    """The report row with a note on small samples."""
    n = F.col("n_bona_fide") + F.col("n_attack")
    return report.withColumn("note", F.when(n < SMALL_SAMPLE, "small sample").otherwise(""))


def markdown_rows(report: DataFrame, rates: DataFrame) -> DataFrame:
    """pos, metric, value: shares in per cent with two decimals, AUC with four."""
    def cells(k: int, metric: str, value):
        return F.struct(F.lit(k).cast("long").alias("pos"), F.lit(metric).alias("metric"), value.alias("value"))

    def percent(c: str):
        return F.concat(F.format_string("%.2f", F.round(F.col(c) * 100, 2)), F.lit("%"))

    fixed = [("EER", percent("eer")), ("AUC", F.format_string("%.4f", F.round("auc", 4))), ("BPCER @ deployed threshold", percent("bpcer")), ("APCER (worst case)", percent("worst_apcer")), ("ACER", percent("acer"))]
    head = report.select(F.explode(F.array(*[cells(k + 1, m, v) for k, (m, v) in enumerate(fixed)])).alias("r")).select("r.*")
    order = Window.orderBy("attack_type")
    types = rates.filter(is_attack(F.col("attack_type"))).select((F.row_number().over(order) + 5).cast("long").alias("pos"), F.concat(F.lit("APCER of "), "attack_type").alias("metric"), percent("rate").alias("value"))
    counts = report.select(F.lit(100).cast("long").alias("pos"), F.lit("Test samples").alias("metric"), F.concat(F.col("n_bona_fide").cast("string"), F.lit(" bona fide / "), F.col("n_attack").cast("string"), F.lit(" attack")).alias("value"))
    return head.unionByName(types).unionByName(counts)


def test_report(scored: DataFrame, threshold: float, source: str = "given", targets: Sequence[float] = TARGETS) -> dict[str, DataFrame]:
    """The whole report of one test set at a given threshold, by part.

    ``summary`` (one row with the threshold and where it comes from), ``types``, ``targets`` (BPCER at each target
    APCER) and, if any sample has conditions, ``conditions`` and ``fairness``, which are otherwise empty.
    """
    strata = stratify(scored, threshold)
    at = evaluate_at(scored, threshold, targets=targets)
    names = {t: f"bpcer_at_{t:.2f}".replace(".", "_") for t in targets}
    lines = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("target"), F.col(c).alias("bpcer")) for t, c in names.items()])).alias("line")
    return {
        "summary": headline(at).withColumn("threshold_source", F.lit(source)),
        "types": type_rows(apcer_bpcer(scored, threshold)),
        "targets": at.select(lines).select("line.*"),
        "conditions": condition_rows(strata),
        "fairness": fairness_rows(fairness_audit(fairness_groups(scored, threshold))),
    }


def top_offenders(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The first few keys, for messages."""
    return df.select(key).orderBy(key).limit(n)
