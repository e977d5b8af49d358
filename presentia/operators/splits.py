"""Leak-free splits: assignment of whole groups, integrity, fingerprints and their verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presentia.functions.annotation import group_key, label


def shuffled_groups(samples: DataFrame, by: str, seed: int, buckets: int | None = None) -> DataFrame:
    """group_key, position (from 0) of the distinct groups in the order of a keyed hash.

    Positions come from offsets of hash ranges, as many as shuffles have partitions, so that no window spans all groups.
    """
    buckets = buckets or max(64, int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    groups = samples.select(group_key(by).alias("group_key")).distinct()
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), "group_key"))
    groups = groups.withColumn("h", h).withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / (4294967296 / buckets)))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row for each bucket
    offsets = groups.groupBy("bucket").agg(F.count(F.lit(1)).alias("t")).select("bucket", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("bucket").orderBy("h", "group_key")
    return groups.join(offsets, "bucket").select("group_key", (F.col("before") + F.row_number().over(inside) - 1).alias("position"))


def group_split(samples: DataFrame, val: float = 0.2, test: float = 0.2, seed: int = 0, by: str = "subject") -> DataFrame:
    """``samples`` with group_key and split (train, val, test); whole groups stay together.

    At least three groups are needed. Sizes are rounded half to even and at least 1; if nothing is left to
    train on, val and test shrink to 1 each.
    """
    if not (0 <= val < 1 and 0 <= test < 1 and val + test < 1):
        raise ValueError("val and test are fractions with a sum under 1")
    order = shuffled_groups(samples, by, seed)
    n = order.count()
    if n < 3:
        raise ValueError("a split needs three groups")
    n_test, n_val = max(1, round(n * test)), max(1, round(n * val))
    if n_test + n_val >= n:
        n_test = n_val = 1
    split = F.when(F.col("position") < n_test, "test").when(F.col("position") < n_test + n_val, "val").otherwise("train")
    return samples.withColumn("group_key", group_key(by)).join(order.select("group_key", split.alias("split")), "group_key")


def split_integrity(split: DataFrame) -> DataFrame:
    """kind, detail rows: groups in two splits, empty splits, splits of one class; none for a good split."""
    leaked = split.groupBy("group_key").agg(F.count_distinct("split").alias("k")).filter("k > 1").select(F.lit("leaked_group").alias("kind"), F.col("group_key").alias("detail"))
    sizes = split.groupBy("split").agg(F.count_distinct(label(F.col("attack_type"))).alias("classes"))
    spark = split.sparkSession
    names = spark.sql("select explode(array('train', 'val', 'test')) as split")
    empty = names.join(sizes, "split", "left_anti").select(F.lit("empty_split").alias("kind"), F.col("split").alias("detail"))
    single = sizes.filter("classes < 2").select(F.lit("single_class").alias("kind"), F.col("split").alias("detail"))
    return leaked.unionByName(empty).unionByName(single)


def subject_overlap(split: DataFrame) -> DataFrame:
    """One row: subjects, and how many of them stand in two splits (possible when splitting by session)."""
    per = split.groupBy("subject").agg(F.count_distinct("split").alias("k"))
    return per.agg(F.count(F.lit(1)).alias("subjects"), F.count_if(F.col("k") > 1).alias("shared"))


def fingerprint(split: DataFrame, by: str) -> DataFrame:
    """split_by, split, group_key: what must be the same later."""
    return split.select(F.lit(by).alias("split_by"), "split", "group_key").distinct()


def verify_split(recorded: DataFrame, test_groups: DataFrame, by: str) -> DataFrame:
    """One row: status, missing, unexpected, trained_on, examples (five of the groups trained on).

    status is not_verified without recorded test groups, mode_differs if the split mode is another one,
    differs if the test groups are not the recorded ones, else verified.
    """
    mine = test_groups.select("group_key").distinct().withColumn("here", F.lit(True))
    theirs = recorded.filter("split = 'test'").select("group_key", "split_by").distinct().withColumn("there", F.lit(True))
    both = mine.join(theirs, "group_key", "full")
    facts = both.agg(
        F.count_if(F.col("there").isNotNull()).alias("recorded_groups"),
        F.count_if(F.col("here").isNull()).alias("missing"),
        F.count_if(F.col("there").isNull()).alias("unexpected"),
        F.count_if(F.col("split_by") != by).alias("other_mode"),
    )
    trained = mine.join(recorded.filter("split = 'train'").select("group_key").distinct(), "group_key", "left_semi")
    n_trained = trained.agg(F.count(F.lit(1)).alias("trained_on"))
    examples = trained.orderBy("group_key").limit(5).agg(F.array_sort(F.collect_list("group_key")).alias("examples"))
    status = (
        F.when(F.col("recorded_groups") == 0, "not_verified").when(F.col("other_mode") > 0, "mode_differs").when((F.col("missing") > 0) | (F.col("unexpected") > 0), "differs").otherwise("verified")
    )
    return facts.join(F.broadcast(n_trained)).join(F.broadcast(examples)).select(status.alias("status"), "missing", "unexpected", "trained_on", "examples")


def shared_subjects(a: DataFrame, b: DataFrame) -> DataFrame:
    """Subjects that stand in both datasets."""
    return a.select("subject").intersect(b.select("subject"))
