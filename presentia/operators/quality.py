"""Quarantine and contracts of ingested rows, whole-subject limits and class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presentia.functions import annotation as A
from presentia.plans.materialize import materialize
from presentia.sources.annotations import write_manifest


def decode(annotations: DataFrame) -> DataFrame:
    """path, vec -> path, subject, attack_type, session, conditions with attributes, label_error; a ``problem`` of reading goes along."""
    return annotations.select(
        *(["problem"] if "problem" in annotations.columns else []),
        "path",
        A.subject_from_path(F.col("path")).alias("subject"),
        A.attack_type(F.col("vec")).alias("attack_type"),
        F.lit("default").alias("session"),
        F.map_concat(A.conditions(F.col("vec")), A.attributes(F.col("vec"))).alias("conditions"),
        A.label_error(F.col("vec")).alias("label_error"),
    )


def reasons(decoded: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """``decoded`` with ``reason``: the problem of reading, bad_path, missing_file or the label error, in that order; null for good rows."""
    missing = F.lit(False)
    if listing is not None:
        decoded = decoded.join(listing.select("path").distinct().withColumn("_there", F.lit(True)), "path", "left")
        missing = F.col("_there").isNull()
    reason = F.when(F.col("subject").isNull(), "bad_path").when(missing, "missing_file").otherwise(F.col("label_error"))
    if "problem" in decoded.columns:
        reason = F.coalesce("problem", reason)
    return decoded.withColumn("reason", reason).drop("_there", "label_error", "problem")


def quarantine(reasoned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and counts by reason. All rows are counted, also those of subjects a later limit drops."""
    bad = reasoned.filter("reason is not null")
    return reasoned.filter("reason is null").drop("reason"), bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def require_some(good: DataFrame) -> DataFrame:
    """``good`` itself; raises if no row is left."""
    if good.isEmpty():
        raise ValueError("every row is quarantined")
    return good


def import_annotations(annotations: DataFrame, path: str, listing: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Decodes annotations, writes the good samples as a manifest at ``path`` and returns the counts of the others by reason.

    With ``limit``, whole subjects only, as long as all earlier ones have fewer samples. Raises if none is good.
    """
    good, counts = quarantine(materialize(reasons(decode(annotations), listing), "reasoned"))
    good = require_some(good)
    write_manifest(good if limit is None else limit_whole_subjects(good, limit), path)
    return counts


def require(df: DataFrame, predicate: Column, message: str) -> DataFrame:
    """``df`` itself; raises with the number of rows that break the predicate (null counts as broken)."""
    broken = df.agg(F.count_if(~F.coalesce(predicate, F.lit(False)))).first()[0]
    if broken:
        raise ValueError(f"{message}: {broken} rows")
    return df


def limit_whole_subjects(samples: DataFrame, limit: int, buckets: int | None = None) -> DataFrame:
    """Subjects in numeric order as long as all earlier ones together have fewer rows than ``limit``.

    Running counts are kept inside buckets of subject number, as many as shuffles have partitions, with an offset
    for each, so no window spans all subjects.
    """
    buckets = buckets or max(64, int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if limit <= 0:
        raise ValueError("the limit must be positive")
    counts = samples.groupBy("subject").agg(F.count(F.lit(1)).alias("n")).withColumn("number", F.col("subject").cast("decimal(38,0)").cast("double"))
    cuts = sorted(set(counts.approxQuantile("number", [k / buckets for k in range(1, buckets)], 0.001)))
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("number"))) if cuts else F.lit(0)
    counts = counts.withColumn("bucket", bucket)
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row for each bucket
    offsets = counts.groupBy("bucket").agg(F.sum("n").alias("t")).select("bucket", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("bucket").orderBy("number", "subject").rowsBetween(Window.unboundedPreceding, -1)
    kept = counts.join(offsets, "bucket").withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))).filter(F.col("before") < limit)
    return samples.join(kept.select("subject"), "subject", "left_semi")


def class_weights(samples: DataFrame) -> DataFrame:
    """label, n, weight: total / (2 n of the class); 1 if there is one class only."""
    counts = samples.groupBy(A.label(F.col("attack_type")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("classes"))
    return counts.join(F.broadcast(total)).select("label", "n", F.when(F.col("classes") < 2, 1.0).otherwise(F.col("total") / (2 * F.col("n"))).alias("weight"))


def manifest_stats(samples: DataFrame) -> DataFrame:
    """attack_type (null: all), n, subjects, sessions, instruments."""
    session = F.concat_ws("/", "subject", "session")
    return samples.rollup("attack_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("subject").alias("subjects"), F.count_distinct(session).alias("sessions"), F.count_distinct("instrument").alias("instruments")
    )
