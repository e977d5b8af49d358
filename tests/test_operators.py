"""Small cases of ingest, splits, galleries, geometry and gates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from presentia.functions import annotation as A
from presentia.functions import geometry as geo
from presentia.operators import frames as R
from presentia.operators import galleries as G
from presentia.operators import models as M
from presentia.operators import quality as Q
from presentia.operators import splits as S
from presentia.operators import trust as T


def test_subject_prefers_structure_over_a_year(spark):
    paths = ["Data/2020/train/55/live/1.png", "Data/train/7/spoof/2.png", "set/12/3.png", "x/3.png", "live/1.png", None]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r.s for r in df.select(A.subject_from_path(F.col("path")).alias("s")).collect()] == ["55", "7", "12", None, None, None]


def test_label_errors_in_order(spark):
    good = [1] * 40 + [1, 1, 1, 1]
    vecs = [good, good[:39], [1] * 40 + [11, 1, 1, 1], [1] * 40 + [1, 1, 1, 0], None]
    df = spark.createDataFrame([(v,) for v in vecs], "vec array<int>")
    assert [r.e for r in df.select(A.label_error(F.col("vec")).alias("e")).collect()] == [None, "short_vector", "unknown_code", "flag_disagrees", "short_vector"]


def test_live_rows_have_no_conditions_and_absent_attributes_are_minus_one(spark):
    live = [-1] * 40 + [0, 1, 1, 0]
    row = spark.createDataFrame([(live,)], "vec array<int>").select(A.conditions(F.col("vec")).alias("c"), A.attributes(F.col("vec")).alias("a")).first()
    assert row.c == {} and set(row.a.values()) == {"no"}


def test_quarantine_of_everything_raises(spark):
    bad = spark.createDataFrame([("x/1.png", [1])], "path string, vec array<int>")
    good, counts = Q.quarantine(Q.reasons(Q.decode(bad)))
    assert [(r.reason, r.n) for r in counts.collect()] == [("bad_path", 1)]
    with pytest.raises(ValueError):
        Q.require_some(good)


def samples(spark, subjects=8, kinds=("bona_fide", "print")):
    rows = [(f"{s}/{k}/{i}.png", k, f"p{s}", "d0", None) for s in range(subjects) for k in kinds for i in range(3)]
    return spark.createDataFrame(rows, "path string, attack_type string, subject string, session string, instrument string")


@pytest.mark.parametrize("seed", [0, 7])
def test_split_keeps_groups_together(spark, seed):
    split = S.group_split(samples(spark), seed=seed)
    assert S.split_integrity(split).count() == 0
    assert {r.split: r.k for r in split.groupBy("split").agg(F.count_distinct("subject").alias("k")).collect()} == {"train": 4, "val": 2, "test": 2}
    again = S.group_split(samples(spark).repartition(7), seed=seed)
    assert sorted(map(tuple, split.select("path", "split").collect())) == sorted(map(tuple, again.select("path", "split").collect()))


def test_split_refuses_bad_input(spark):
    with pytest.raises(ValueError):
        S.group_split(samples(spark, subjects=2))
    with pytest.raises(ValueError):
        S.group_split(samples(spark), val=0.6, test=0.5)


def test_integrity_names_its_faults(spark):
    split = S.group_split(samples(spark), seed=1)
    leaky = split.withColumn("split", F.when(F.col("path").endswith("0.png"), "train").otherwise(F.col("split"))).filter("split <> 'val'")
    assert {"leaked_group", "empty_split"} <= {r.kind for r in S.split_integrity(leaky).collect()}


def test_class_weights_of_one_class_are_one(spark):
    assert {r.weight for r in Q.class_weights(samples(spark, kinds=("print",))).collect()} == {1.0}


def test_limit_keeps_whole_subjects(spark):
    df = spark.createDataFrame([(f"{s}", i) for s in (2, 10, 1) for i in range(5)], "subject string, i int")
    kept = Q.limit_whole_subjects(df, 6)
    assert {r.subject for r in kept.select("subject").distinct().collect()} == {"1", "2"} and kept.count() == 10
    with pytest.raises(ValueError):
        Q.limit_whole_subjects(df, 0)


def unit(k, dim=8, eps=0.0):
    v = [eps] * dim
    v[k] = 1.0
    return v


def gallery(spark):
    rows = [("a", i, unit(0, eps=0.01 * i)) for i in range(3)] + [("b", 10 + i, unit(1, eps=0.01 * i)) for i in range(3)]
    return spark.createDataFrame(rows, "name string, ordinal bigint, v array<double>")


def test_identify_thresholds_ties_and_non_finite(spark):
    probes = spark.createDataFrame([(1, unit(0)), (2, unit(5)), (3, [float("nan")] + [0.0] * 7), (4, [0.0] * 8)], "probe_id bigint, v array<double>")
    out = {r.probe_id: (r.name, round(r.similarity, 6)) for r in G.identify(probes, gallery(spark)).collect()}
    assert out[1] == ("a", 1.0) and out[2][0] is None and out[3] == (None, 0.0) and out[4] == (None, 0.0)
    empty = G.identify(probes, gallery(spark).limit(0)).collect()
    assert all(r.database_empty and r.name is None for r in empty)


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    pairs = sorted(map(tuple, G.pair_similarities(gallery(spark)).select("a", "b", "genuine").collect()))
    monkeypatch.setattr(G, "BLOCK", 2)
    assert sorted(map(tuple, G.pair_similarities(gallery(spark)).select("a", "b", "genuine").collect())) == pairs
    assert len(pairs) == 15 and sum(p[2] for p in pairs) == 6


def test_calibration_of_a_separable_gallery(spark):
    row = G.calibrate_threshold(G.pair_similarities(gallery(spark))).first()
    assert row.separable and row.errors == 0 and row.gap > 0
    with pytest.raises(ValueError):
        G.require_pairs(G.pair_similarities(gallery(spark).filter("name = 'a'")))


def test_enrolment_dedups_caps_and_rejects(spark):
    batch = spark.createDataFrame([(" a ", k, unit(k)) for k in range(8)] + [("a", 20, unit(3))], "name string, arrival bigint, v array<double>")
    kept = G.enroll(gallery(spark), batch, 8)
    assert sorted(r.arrival for r in kept.collect()) == [1, 2, 3, 4, 5, 6, 7]
    assert G.enroll(gallery(spark), batch, 8, cap=5).count() == 2
    for bad in [("a", 1, [float("nan")] * 8), ("a", 1, [1.0] * 7), ("  ", 1, unit(0))]:
        with pytest.raises(ValueError):
            G.enroll(gallery(spark), batch.unionByName(spark.createDataFrame([bad], batch.schema)), 8)


def test_alignment_of_rotation_and_bad_points(spark):
    moved = [(2 * x + 5.0, 2 * y - 3.0) for x, y in geo.TEMPLATE]
    rows = [(moved,), ([(1.0, 1.0)] * 5,), (moved[:4],), ([(float("nan"), 0.0)] * 5,)]
    df = spark.createDataFrame(rows, "kps array<struct<x:double,y:double>>")
    out = [r.a for r in df.select(geo.alignment_params(F.col("kps")).alias("a")).collect()]
    assert out[0].p == pytest.approx(0.5) and out[0].q == pytest.approx(0.0) and out[0].tx == pytest.approx(-2.5)
    assert (out[1].p, out[1].q) == (1.0, 0.0) and out[2] is None and out[3] is None


def test_nms_suppresses_the_weaker_overlap(spark):
    df = spark.createDataFrame([(1, 1, 0, 0, 10, 10, 0.9), (1, 2, 1, 1, 11, 11, 0.8), (1, 3, 50, 50, 60, 60, 0.1)], "image_id bigint, cand_id bigint, x1 int, y1 int, x2 int, y2 int, score double")
    assert sorted(r.cand_id for r in R.nms(df).collect()) == [1, 3]


def test_spoof_comes_before_a_name(spark):
    df = spark.createDataFrame([(False, "a"), (None, "a"), (True, "a"), (True, None)], "live boolean, name string")
    assert [r.s for r in df.select(T.trust_status(F.col("live"), F.col("name")).alias("s")).collect()] == ["SPOOF", "UNVERIFIED", "TRUSTED", "UNKNOWN"]


def test_rejected_faces_never_carry_a_name_and_a_gate_needs_liveness(spark):
    faces = spark.createDataFrame([(1, 1, 0.9), (2, 1, 0.1), (3, 1, None)], "face_id bigint, vec_id bigint, spoof_probability double")
    vecs = spark.createDataFrame([(1, unit(0))], "vec_id bigint, v array<double>")
    out = {r.face_id: (r.name, r.status) for r in T.recognize(faces, vecs, gallery(spark), 0.5).collect()}
    assert out == {1: (None, "SPOOF"), 2: ("a", "TRUSTED"), 3: ("a", "UNVERIFIED")}
    with pytest.raises(ValueError):
        T.recognize(faces.drop("spoof_probability"), vecs, gallery(spark), 0.5)
    off = T.recognize(faces.drop("spoof_probability"), vecs, gallery(spark), 0.5, require_liveness=False)
    assert {r.status for r in off.collect()} == {"UNVERIFIED"}


def test_thinning_keeps_its_gap_and_target(spark):
    df = spark.createDataFrame([("a", i) for i in range(0, 200, 5)], "who string, frame_id bigint")
    got = sorted(r.frame_id for r in R.thin_frames(df, ["who"]).collect())
    assert got == [0, 15, 30, 45, 60, 75, 90, 105]


def test_checkpoint_stops_after_patience(spark):
    rows = [(1, e, 0.5 if e != 3 else 0.2, 1.0) for e in range(20)]
    row = M.select_checkpoint(spark.createDataFrame(rows, "run_id bigint, epoch bigint, val_eer double, val_loss double")).first()
    assert (row.best_epoch, row.best_eer, row.stopped_at) == (3, 0.2, 11)


def test_augmentation_does_not_depend_on_partitions(spark):
    one, many = (sorted(map(tuple, geo.augmentation_plan(samples(spark).repartition(n), 2, 9).collect()), key=str) for n in (1, 5))
    assert one == many and len(one) == 96


def plain_nms(boxes, iou):
    """By comparing with all that is kept."""
    kept = []
    for box in boxes:
        x1, y1, x2, y2 = box
        hit = False
        for a1, b1, a2, b2 in kept:
            inter = max(0, min(x2, a2) - max(x1, a1) + 1) * max(0, min(y2, b2) - max(y1, b1) + 1)
            hit = hit or inter / ((x2 - x1 + 1) * (y2 - y1 + 1) + (a2 - a1 + 1) * (b2 - b1 + 1) - inter) > iou
        if not hit:
            kept.append(box)
    return kept


@pytest.mark.parametrize("iou", [0.05, 0.4, 0.8])
def test_suppression_by_a_grid_equals_plain_comparison(iou):
    rng = np.random.default_rng(int(iou * 100))
    for low, high, spread in ((0, 2, 40), (1, 60, 300), (1, 2000, 3000)):
        corner, size = rng.integers(0, spread, (500, 2)), rng.integers(low, high, (500, 2))
        boxes = [(int(x), int(y), int(x + w), int(y + h)) for (x, y), (w, h) in zip(corner, size, strict=True)]
        kept = R.Kept(iou)
        assert [b for b in boxes if kept.takes(b)] == plain_nms(boxes, iou) and (kept.cells is not None or spread == 40)


def test_suppression_in_an_image_of_many_candidates(spark):
    n = 100_000
    rows = spark.range(n).selectExpr("1L as image_id", "id as cand_id", "cast(pmod(id * 7919, 20000) as int) as x1", "cast(pmod(id * 104729, 20000) as int) as y1", "double(pmod(id * 31, 1000)) as score")
    rows = rows.selectExpr("image_id", "cand_id", "x1", "y1", "cast(x1 + 60 + cand_id % 50 as int) as x2", "cast(y1 + 60 + cand_id % 70 as int) as y2", "score")
    extra = spark.createDataFrame([(2, 1, None, 0, 5, 5, 1.0), (2, 2, 0, 0, 5, 5, None), (2, 3, 0, 0, 5, 5, 0.5), (None, 4, 0, 0, 5, 5, 0.5)], "image_id bigint, cand_id bigint, x1 int, y1 int, x2 int, y2 int, score double")
    out = R.nms(rows.unionByName(extra)).collect()
    assert sorted(r.cand_id for r in out if r.image_id == 2) == [1, 2] and [r.cand_id for r in out if r.image_id is None] == [4]
    kept = [r for r in out if r.image_id == 1]
    part = [r for r in kept if r.x1 < 1500 and r.y1 < 1500]  # what a corner of the image keeps depends on its surroundings alone
    near = sorted((r for r in rows.filter("x1 < 1500 and y1 < 1500").collect()), key=lambda r: (-r.score, r.cand_id))
    assert 0 < len(part) < len(near)
    inner = lambda rs: {tuple(r[2:6]) for r in rs if r.x2 < 1000 and r.y2 < 1000}
    plain = set(plain_nms([tuple(r[2:6]) for r in near], R.NMS_IOU))
    assert {b for b in plain if b[2] < 1000 and b[3] < 1000} == inner(part)
