"""Literal cases worked by hand, and invariance of the curves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from presentia.operators import evaluation as E


def scored(spark, rows):
    return spark.createDataFrame([(i, t, float(s)) for i, (t, s) in enumerate(rows)], "sample_id bigint, attack_type string, score double")


BASE = [("bona_fide", x) for x in (0.1, 0.2, 0.9, 0.4)] + [("print", x) for x in (0.8, 0.3)] + [("replay", x) for x in (0.7, 0.6, 0.2, 0.1)]


def test_rates_and_operating_point(spark):
    rates = E.apcer_bpcer(scored(spark, BASE), 0.5)
    assert {r.attack_type: r.rate for r in rates.collect()} == {"bona_fide": 0.25, "print": 0.5, "replay": 0.5}
    point = E.operating_point(rates).first()
    assert (point.worst_apcer, point.mean_apcer, point.acer) == (0.5, 0.5, 0.375)


def test_an_untested_type_is_absent_and_missing_classes_are_zero(spark):
    only = scored(spark, [("bona_fide", 0.1), ("bona_fide", 0.7)])
    point = E.operating_point(E.apcer_bpcer(only, 0.5)).first()
    assert (point.bpcer, point.worst_apcer, point.n_attack) == (0.5, 0.0, 0)


def test_auc_averages_ties(spark):
    tied = scored(spark, [("bona_fide", 0.2), ("bona_fide", 0.5), ("print", 0.5), ("print", 0.8)])
    assert E.auc_of(E.curve(tied)).first().auc == pytest.approx(0.875)
    same = scored(spark, [("bona_fide", 0.5), ("bona_fide", 0.5), ("print", 0.5), ("print", 0.5)])
    assert E.auc_of(E.curve(same)).first().auc == pytest.approx(0.5)
    assert E.auc_of(E.curve(scored(spark, [("print", 0.5)]))).first().auc is None


def test_eer_of_a_perfect_and_an_inverted_model(spark):
    perfect = scored(spark, [("bona_fide", 0.1), ("bona_fide", 0.2), ("print", 0.8), ("print", 0.9)])
    assert E.eer_of(E.curve(perfect)).first().asDict() == {"eer": 0.0, "eer_threshold": 0.8}
    inverted = scored(spark, [("bona_fide", 0.8), ("bona_fide", 0.9), ("print", 0.1), ("print", 0.2)])
    assert E.eer_of(E.curve(inverted)).first().eer == 1.0
    assert E.bpcer_at_apcer_of(E.curve(inverted), 0.0).first().bpcer == 1.0


def test_target_one_clamps_and_bad_targets_raise(spark):
    points = E.curve(scored(spark, BASE))
    row = E.bpcer_at_apcer_of(points, 1.0).first()
    assert (row.bpcer, row.threshold, row.threshold_clamped) == (0.0, 0.9, True)
    with pytest.raises(ValueError):
        E.bpcer_at_apcer_of(points, 1.5)


def test_roc_is_monotone_and_independent_of_partitioning(spark):
    rows = spark.range(4000).select(
        F.col("id").alias("sample_id"), F.when(F.col("id") % 3 == 0, "bona_fide").otherwise("print").alias("attack_type"), (F.pmod(F.xxhash64("id"), F.lit(997)) / 997.0).alias("score")
    )
    one, many = (sorted(tuple(r) for r in E.roc(rows.repartition(n)).collect()) for n in (1, 9))
    assert one == many
    assert all(a[1] <= b[1] and a[2] >= b[2] for a, b in zip(one, one[1:], strict=False))


def test_invalid_scores_raise(spark):
    assert E.require_valid_scores(scored(spark, [("print", 0.0), ("bona_fide", 1.0)])).count() == 2
    for bad in (("print", float("nan")), ("print", 1.2), ("mask", 0.5)):
        with pytest.raises(ValueError):
            E.require_valid_scores(scored(spark, [bad]))


def test_join_scores_refuses_gaps_and_repeats(spark):
    m = scored(spark, BASE)
    s = m.select("sample_id", "score")
    assert E.join_scores(m.drop("score"), s).count() == len(BASE)
    for broken in (s.filter("sample_id > 0"), s.unionByName(s.limit(1)), s.withColumn("sample_id", F.col("sample_id") + 1)):
        with pytest.raises(ValueError):
            E.join_scores(m.drop("score"), broken)


@pytest.mark.parametrize(
    ("eer", "apcer", "bpcer", "verdict"),
    [(0.2, 0.0, 0.0, "discrimination_collapse"), (0.0, 0.5, 0.0, "threshold_did_not_transfer"), (0.0, 0.0, 0.05, "moderate"), (0.01, 0.01, 0.0, "small")],
)
def test_cross_dataset_verdicts(spark, eer, apcer, bpcer, verdict):
    schema = "auc double, eer double, worst_apcer double, bpcer double, acer double"
    out = E.cross_dataset(spark.createDataFrame([(1.0, 0.0, 0.0, 0.0, 0.0)], schema), spark.createDataFrame([(0.9, eer, apcer, bpcer, 0.1)], schema))
    assert {r.verdict for r in out.collect()} == {verdict}
    assert {r.metric: r.direction for r in out.collect()}["auc"] == "worse"


def test_small_buckets_have_no_rate_and_fairness_needs_two_groups(spark):
    rows = [("print", 0.1 if i < 5 else 0.9, {"illumination": "dark" if i < 10 else "back"}) for i in range(40)]
    rows += [("bona_fide", 0.9 if i % 10 == 0 else 0.1, {"attr:Hat": "yes" if i < 60 else "no"}) for i in range(90)]
    df = spark.createDataFrame(rows, "attack_type string, score double, conditions map<string,string>")
    strata = {r.value: (r.n, r.missed, r.apcer) for r in E.stratify(df, 0.5).collect()}
    assert strata == {"dark": (10, 5, None), "back": (30, 0, 0.0)}
    audit = E.fairness_audit(E.fairness_groups(df, 0.5)).first()
    assert audit.rated == 1 and audit.ratio is None and audit.flagged is None


@pytest.mark.parametrize("window", [1, 7, 1000])
def test_running_counts_do_not_depend_on_the_ranges(spark, window):
    rng = np.random.default_rng(window)
    rows = [(f"g{rng.integers(0, 3)}", float(rng.integers(0, 40)) / 8, bool(rng.integers(0, 2)), int(rng.integers(1, 4))) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, v double, p boolean, w int")
    for by in ([], ["g"]):
        out = E.prefix_counts(df, "v", F.col("p"), by, F.col("w"), window_rows=window).collect()
        groups = {tuple(r[: len(by)]) for r in rows} if by else {()}
        assert len(out) == sum(len({r[1] for r in rows if tuple(r[: len(by)]) == k}) for k in groups)
        for r in out:
            own = [x for x in rows if tuple(x[: len(by)]) == tuple(r[c] for c in by)]
            count = lambda kind, test, own=own: sum(x[3] for x in own if x[2] is kind and test(x[1]))
            v = r.value
            assert (r.a, r.b, r.n_a, r.n_b) == (count(True, lambda x: x == v), count(False, lambda x: x == v), count(True, lambda x: True), count(False, lambda x: True))
            assert (r.below_a, r.below_b) == (count(True, lambda x: x < v), count(False, lambda x: x < v))
