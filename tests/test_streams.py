"""Streams held against batch operators and against plain Python; models and enrolment against brute force."""

import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from presentia.operators import evaluation as E
from presentia.operators import frames as R
from presentia.operators import galleries as G
from presentia.operators import models as M
from presentia.operators import reports
from presentia.operators import splits as S
from presentia.operators import trust as T
from presentia.plans.materialize import materialize
from presentia.queries import evaluation, galleries, jobs, serving
from presentia.queries.adapters import adapted
from presentia.sources import gallery_store as store
from presentia.streaming import faces as ST


def faces_of(spark, sf):
    return adapted(spark, sf, "faces").withColumn("ts", F.col("ts").cast("timestamp")).collect()


def test_trust_stream_replays_the_batch(spark, sf):
    got = sorted(map(tuple, jobs.h1_stream_trust(spark, sf).collect()), key=str)
    assert got == sorted(map(tuple, serving.c3_recognize(spark, sf).collect()), key=str)


def test_history_stream_equals_a_plain_fold(spark, sf):
    got = {r.face_id: (r.camera, r.n, r.mean_score) for r in jobs.h2_stream_score_history(spark, sf).collect()}
    held, want = {}, {}
    for r in sorted(faces_of(spark, sf), key=lambda r: (r.ts, r.face_id)):
        if r.spoof_probability is None:
            continue
        key = r.camera, (r.x1 + r.x2) // 240, (r.y1 + r.y2) // 240
        last, scores = held.get(key, (None, []))
        if last is not None and (r.ts - last).total_seconds() > 24 * 3600:
            scores = []
        scores = [*scores, r.spoof_probability][-R.HISTORY :]
        held[key] = r.ts, scores
        want[r.face_id] = r.camera, len(scores), pytest.approx(sum(scores) / len(scores), abs=2e-6)
    assert got == want


def stamp(at) -> str:
    return at if isinstance(at, str) else f"{at:%Y-%m-%d %H:%M:%S.%f}"


def watermark_of(spark, sf, late_hours):
    """What the last watermark is after all of the replayed files: the newest time of all batches less the lateness."""
    newest = max(r.ts for r in faces_of(spark, sf))
    return newest - timedelta(hours=late_hours)


def test_closed_sessions_of_the_presence_stream_are_those_of_the_batch(spark, sf):
    key = lambda r: (r.camera, r.cell_x, r.cell_y, stamp(r.start), stamp(r.end), r.faces)
    stream = sorted(map(key, jobs.h5_stream_presence(spark, sf).collect()))
    batch = ST.presence(adapted(spark, sf, "faces").withColumn("ts", F.col("ts").cast("timestamp"))).collect()
    # Files come in order of time, so no row is late: every session that ends by the last watermark is there, once, and no other.
    mark = watermark_of(spark, sf, 6)
    assert stream == sorted(key(r) for r in batch if r.end <= mark)


def test_closed_windows_of_the_statistics_stream_are_those_of_the_batch(spark, sf):
    key = lambda r: (r.camera, stamp(r.start), stamp(r.end), r.faces, round(r.detect_ms, 6), round(r.liveness_ms, 6))
    stream = sorted(key(r) for r in jobs.h4_stream_frame_stats(spark, sf).collect())
    batch = ST.frame_stats(adapted(spark, sf, "faces").withColumn("ts", F.col("ts").cast("timestamp"))).collect()
    mark = watermark_of(spark, sf, 1)
    assert stream == sorted(key(r) for r in batch if r.end <= mark)


def test_late_rows_show_in_the_progress_of_a_stream(spark, tmp_path):
    schema = "face_id bigint, camera bigint, ts timestamp, detect_ms double, liveness_ms double, recognize_ms double"
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    # Two rows of the third file are ten hours late; what is late is judged by the watermark of the batch before.
    for hours in ([0, 1, 10], [11], [12, 0, 1]):
        spark.createDataFrame([(k, 0, at(h), 1.0, 1.0, 1.0) for k, h in enumerate(hours)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    log = ST.ProgressLog()
    spark.streams.addListener(log)
    try:
        stream = ST.frame_stats(ST.read_faces(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema))
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        query.awaitTermination()
        until = time.time() + 20
        while time.time() < until and sum(r.rows_in for r in log.rows(spark, query.id).collect()) < 7:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    rows = log.rows(spark, query.id).orderBy("batch").collect()
    assert sum(r.rows_in for r in rows) == 7 and sum(r.rows_late for r in rows) == 2
    assert [r.rows_in for r in rows if r.rows_late] == [3] and all(r.watermark for r in rows)


def test_capture_stream_fills_up_to_its_target_in_order(spark, tmp_path):
    rows = [(i, i % 2, i, 0, 0, 100 if i % 4 else 50, 100) for i in range(60)]
    schema = "face_id bigint, camera bigint, frame_id bigint, x1 int, y1 int, x2 int, y2 int"
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = ST.read_faces(spark, f"{tmp_path}/in", spark.createDataFrame(rows, schema).schema)
    ST.stream_capture(stream, f"{tmp_path}/out", f"{tmp_path}/ck", target=12).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    usable = [r[2] for r in rows if r[2] % 3 == 0 and r[5] >= 80]
    assert len(got) == 12 and {r.frame_id for r in got} <= set(usable) and len({r.frame_id for r in got}) == 12
    counts = {r.batch: r.captured for r in spark.read.parquet(f"{tmp_path}/out-progress").collect()}
    assert counts[max(counts)] == 12 and sorted(counts.values()) == [counts[k] for k in sorted(counts)]


def test_enrolment_stream_keeps_gaps_across_batches_and_single_live_faces(spark, tmp_path):
    dim = 8
    eye = np.eye(dim).tolist()
    # frame, faces in it, liveness; name a, camera 0, every frame an axis of its own
    shots = [(0, 1, 0.1), (5, 1, 0.1), (12, 2, 0.1), (13, 1, 0.9), (14, 1, None), (15, 1, 0.1), (26, 1, 0.1), (27, 1, 0.1), (60, 1, 0.1)]
    rows, number = [], 0
    for frame, n, p in shots:
        for _ in range(n):
            rows.append((number, "a", 0, frame, 0, 0, 200, 200, p, number % dim, 90.0))
            number += 1
    schema = "face_id bigint, name string, camera bigint, frame_id bigint, x1 int, y1 int, x2 int, y2 int, spoof_probability double, vec_id bigint, sharpness double"
    root = f"{tmp_path}/g"
    G.write_gallery(spark.createDataFrame([("b", 7, eye[0])], "name string, ordinal bigint, v array<float>"), root, 0, threshold=0.5)
    vectors = spark.createDataFrame(list(enumerate(eye)), "vec_id bigint, v array<double>")
    want, last = [], None
    for frame, n, p in shots:
        if n == 1 and p is not None and p < 0.5 and (last is None or frame - last >= R.MIN_GAP):
            want.append(frame)
            last = frame
    # The stream ends and starts again between its batches.
    for part in (rows[:7], rows[7:9], rows[9:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        with jobs._rocksdb(spark):
            stream = ST.read_faces(spark, f"{tmp_path}/in", spark.createDataFrame(rows, schema).schema)
            ST.stream_enroll(stream, vectors, root, dim, 0.5, (640, 480), f"{tmp_path}/ck").awaitTermination()
    log = [(r.batch, r.frame_id) for r in spark.read.parquet(f"{root}-accepted").collect()]
    assert sorted(f for _, f in log) == want == [0, 15, 27, 60] and len({b for b, _ in log}) > 1
    assert G.read_gallery(spark, root, dim).filter("name = 'a'").count() == 3  # frame 27 shows what frame 0 did
    now = store.read(spark, root)
    assert now.threshold == 0.5 and len(now.entry.parts) == now.version + 1 and now.vectors.count() == 4
    # A batch that comes again adds nothing.
    again = store.append(now.vectors, root, (store.stream_name(spark, f"{tmp_path}/ck"), 0))
    assert again.version == now.version


def test_galleries_are_whole_whatever_happens_to_their_writers(spark, tmp_path):
    root, schema = f"{tmp_path}/g", "name string, ordinal bigint, v array<double>"
    rows = lambda *names: spark.createDataFrame([(n, k, [1.0, float(k)]) for k, n in enumerate(names)], schema)
    meta = spark.createDataFrame([("a", "friend", "2020")], store.META)
    with pytest.raises(ValueError, match="no gallery"):
        store.read(spark, root)
    G.write_gallery(rows("a", "b"), root, 1, meta, 0.4)
    reader = store.read(spark, root)
    # Torn versions: data without an entry, an entry that was never renamed.
    rows("torn").write.parquet(f"{root}/data/vectors-torn")
    (tmp_path / "g" / "_log" / ".half").write_text('{"version": 2, "par')
    assert store.versions(spark, root) == [1] and store.read(spark, root).vectors.count() == 2
    # Two writers from one version: the second is refused, and what it has written is not seen.
    base = store.entry(spark, root)
    store.replace(rows("a", "b", "c"), root, base=base)
    with pytest.raises(store.VersionTaken):
        store.replace(rows("z"), root, base=base)
    with pytest.raises(store.VersionTaken):
        G.write_gallery(rows("z"), root, 2)
    assert {r.name for r in G.read_gallery(spark, root, 2).collect()} == {"a", "b", "c"}
    # A reader that began before sees its version, and meta and threshold stay with what follows.
    assert {r.name for r in reader.vectors.collect()} == {"a", "b"} == {r.name for r in G.read_gallery(spark, root, 2, version=1).collect()}
    now = store.read(spark, root)
    assert now.threshold == 0.4 and now.meta.collect() == reader.meta.collect()
    # Appending is tried again on what another writer left; compaction keeps the rows; vacuum what is named.
    for k in range(4):
        store.append(rows(f"n{k}"), root)
    assert len(store.entry(spark, root).parts) == 5 and store.append(rows("x").limit(0), root).version == 6
    assert len(store.compact(spark, root, 4).parts) == 1 and store.read(spark, root).vectors.count() == 7
    gone = store.vacuum(spark, root, keep=1)
    assert "data/vectors-torn" in gone and store.versions(spark, root) == [7] and store.read(spark, root).vectors.count() == 7
    assert store.read(spark, root).meta.count() == 1


def test_enrolment_of_the_table_against_a_plain_fold(spark, sf):
    old = adapted(spark, sf, "gallery").collect()
    unit = lambda v: np.array(v, float) / max(np.linalg.norm(np.array(v, float)), G.LEAST_NORM)
    held = {}
    for r in sorted(old, key=lambda r: r.ordinal):
        if len(held.setdefault(r.name, [])) < G.CAP:
            held[r.name].append(unit(r.v))
    kept = {}
    for r in sorted(adapted(spark, sf, "probes").collect(), key=lambda r: r.probe_id):
        own = held.setdefault(f"p{r.probe_id // 2 % 10}", [])
        v = unit(r.v)
        if len(own) < G.CAP and (not own or max(float(x @ v) for x in own) < G.DUPLICATE):
            own.append(v)
            name = f"p{r.probe_id // 2 % 10}"
            kept[name] = kept.get(name, 0) + 1
    assert {r.name: r.kept for r in galleries.d23_enroll(spark, sf).collect()} == kept


def brute_eer(kinds, scores):
    bona, attack = (np.array([s for k, s in zip(kinds, scores, strict=True) if (k == "bona_fide") is b]) for b in (True, False))
    best = min((abs((attack < t).mean() - (bona >= t).mean()), t) for t in np.unique(scores))
    return ((attack < best[1]).mean() + (bona >= best[1]).mean()) / 2


def test_the_chosen_scorer_has_the_lowest_validation_eer_and_its_reports_are_right(spark, sf):
    # An observed frame gives the session a state that cannot be shipped; models must not carry the session along.
    seen = Observation()
    spark.range(5).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 5
    run = M.load_run(spark, jobs._trained(spark, sf))
    split = S.group_split(jobs._features(spark, sf), seed=3)
    val = M.spoof_scores(run.model, split.filter("split = 'val'")).collect()
    eer = brute_eer([r.attack_type for r in val], [r.score for r in val])
    history = run.history.orderBy("place").collect()
    assert len(history) == 3 and history[0].threshold == run.threshold and run.split_by == "subject"
    assert history[0].val_eer == pytest.approx(eer) == pytest.approx(min(r.val_eer for r in history))
    own = run.validation.first()
    assert own.threshold_source == "validation EER" and own.eer == pytest.approx(eer) and own.n_bona_fide + own.n_attack == len(val)
    test = M.spoof_scores(run.model, split.filter("split = 'test'")).collect()
    bona = [r.score for r in test if r.attack_type == "bona_fide"]
    rates = [np.mean([r.score < run.threshold for r in test if r.attack_type == k]) for k in {r.attack_type for r in test} - {"bona_fide"}]
    for row in (jobs.j2_train_and_report(spark, sf).first(), jobs.j3_eval_saved_scorer(spark, sf).first()):
        assert row.threshold == pytest.approx(run.threshold)
        assert row.n_bona_fide == len(bona) and row.bpcer == pytest.approx(sum(s >= run.threshold for s in bona) / len(bona))
        assert row.worst_apcer == pytest.approx(max(rates)) and row.eer == pytest.approx(brute_eer([r.attack_type for r in test], [r.score for r in test]))
    assert jobs.i2_fit_scorer(spark, sf).count() == split.count()


def test_runs_are_refused_unless_whole_and_are_never_replaced(spark, sf, tmp_path):
    scored = materialize(S.group_split(evaluation._scored(spark, sf), seed=7), "split")
    val, records = scored.filter("split = 'val'"), [{"reg": 0.0, "val_eer": 0.3, "threshold": 0.5, "loss": 0.0}]
    M.save_run(f"{tmp_path}/a", None, records, scored, val)
    run = M.load_run(spark, f"{tmp_path}/a")
    assert run.model is None and run.threshold == 0.5
    with pytest.raises(ValueError, match="already"):
        M.save_run(f"{tmp_path}/a", None, records, scored, val)
    other = S.group_split(evaluation._scored(spark, sf), seed=8)
    with pytest.raises(ValueError, match="recorded"):
        jobs._verified(other, run)
    assert jobs._verified(scored, run).count() > 0
    with pytest.raises(ValueError, match="no run"):
        M.load_run(spark, f"{tmp_path}/b")
    for k, text in enumerate(("{", '{"run_id": 1, "split_by": "subject"}', "")):
        spark.createDataFrame([(text,)], "value string").write.text(f"{tmp_path}/c{k}/summary")
        with pytest.raises(ValueError, match="no run"):
            M.load_run(spark, f"{tmp_path}/c{k}")


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_matching_by_broadcast_and_by_pivots_are_the_same(spark, sf, limit, monkeypatch):
    monkeypatch.setattr(G, "PIVOT_ROWS", 20)
    monkeypatch.setattr(G, "HELD_BYTES", 5000)
    monkeypatch.setattr(G, "HELD_PROBES", 70)
    out = G.identify(adapted(spark, sf, "probes"), adapted(spark, sf, "gallery"), broadcast_bytes=limit).collect()
    own = sorted(adapted(spark, sf, "gallery").collect(), key=lambda r: r.ordinal)
    m = np.array([r.v for r in own], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    probes = {r.probe_id: np.array(r.v) for r in adapted(spark, sf, "probes").collect()}
    assert len(out) == len(probes)
    for r in out:
        sims = m @ (probes[r.probe_id] / np.linalg.norm(probes[r.probe_id]))
        assert r.similarity == pytest.approx(sims.max()) and (r.name == own[int(sims.argmax())].name if sims.max() >= G.THRESHOLD else r.name is None)


def clustered(seed, n, dim=16, centres=12, spread=0.05):
    """Vectors around a few centres, with repeated, zero and tiny ones."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    rows = middle[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))
    rows[5], rows[6], rows[7] = rows[4], 0.0, 1e-14 * rows[8]
    return rows


def test_pivots_skip_pairs_and_lose_none(spark, monkeypatch):
    monkeypatch.setattr(G, "PIVOT_ROWS", 16)
    monkeypatch.setattr(G, "BLOCK", 40)
    own, asked = clustered(1, 400), clustered(1, 400)[::3] + 0.01
    gallery = spark.createDataFrame([(f"n{k % 7}", k, v.tolist()) for k, v in enumerate(own)], "name string, ordinal bigint, v array<double>")
    probes = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(asked)], "probe_id bigint, v array<double>")
    unit, ask = G._unit(own), G._unit(asked)
    out = {r.probe_id: r for r in G.identify(probes, gallery, 0.9, broadcast_bytes=0).collect()}
    sims = ask @ unit.T
    for k in range(len(asked)):
        best = np.flatnonzero(np.isclose(sims[k], sims[k].max(), rtol=0, atol=1e-12))[0]
        assert out[k].similarity == pytest.approx(sims[k].max(), abs=1e-9) and out[k].name == (f"n{best % 7}" if sims[k].max() >= 0.9 else None)
    assert G.computed_share(probes, gallery) < 0.5
    for least in (0.95, 0.3, -1.0):
        got = {(r.a, r.b): r for r in G.pair_similarities(gallery, least).collect()}
        all_sims = unit @ unit.T
        want = {(i, j) for i in range(400) for j in range(i + 1, 400) if all_sims[i, j] >= least}
        edge = {(i, j) for i, j in want ^ set(got) if abs(all_sims[i, j] - least) > 1e-9}
        assert not edge and all(r.genuine == (a % 7 == b % 7) for (a, b), r in got.items())
    with pytest.raises(ValueError, match="pairs"):
        G.pair_similarities(gallery, most_pairs=1000)
    # One vector that is not finite makes every similarity doubtful, a doubtful probe only its own.
    bad = gallery.unionByName(spark.createDataFrame([("x", 900, [float("nan")] * 16)], gallery.schema))
    assert {(r.name, r.similarity) for r in G.identify(probes, bad, 0.9, broadcast_bytes=0).collect()} == {(None, 0.0)}
    odd = probes.unionByName(spark.createDataFrame([(900, [float("inf")] * 16)], probes.schema))
    again = {r.probe_id: (r.name, r.similarity) for r in G.identify(odd, gallery, 0.9, broadcast_bytes=0).collect()}
    assert again.pop(900) == (None, 0.0) and again == {k: (r.name, pytest.approx(r.similarity, abs=1e-12)) for k, r in out.items()}


def test_pair_counts_hold_all_pairs_and_blocks_do_not_matter(spark, sf, monkeypatch):
    g = adapted(spark, sf, "gallery_all")
    whole = sorted(map(tuple, G.pair_counts(g).select("genuine", "similarity", "n").collect()))
    n = g.count()
    assert sum(r[2] for r in whole) == n * (n - 1) // 2
    monkeypatch.setattr(G, "BLOCK", 100)
    assert sorted(map(tuple, G.pair_counts(g).select("genuine", "similarity", "n").collect())) == whole
    with pytest.raises(ValueError):
        G.pair_stats(G.pair_counts(g.limit(1)))
    with pytest.raises(ValueError):
        G.calibrate_threshold(G.pair_counts(g.withColumn("name", F.lit("one"))))


@pytest.mark.parametrize("width", [15_000, 1 << 18])
def test_histories_do_not_depend_on_the_spans(spark, width):
    rng = np.random.default_rng(1)
    rows = [(i, 0, i, int(rng.integers(0, 2)) * 500, 0, 100, 100, float(rng.random())) for i in range(40_000)]
    rows = [(i, c, f, x, y, x + 100, y2, s) for i, c, f, x, y, _, y2, s in rows]
    df = spark.createDataFrame(rows, "face_id bigint, camera bigint, frame_id bigint, x1 int, y1 int, x2 int, y2 int, spoof_probability double")
    got = {r.face_id: (r.tick, r.n) for r in R.score_history(df, width=width).collect()}
    seen = {}
    for i, *_, in rows:
        cell = rows[i][3]
        last, k = seen.get(cell, (None, 0))
        k = 1 if last is not None and i + 1 - last > R.HISTORY + 1 else min(R.HISTORY, k + 1)
        seen[cell] = i + 1, k
        assert got[i] == (i + 1, k)
    fps = R.rolling_fps(df.select("camera", "frame_id", F.lit(10.0).alias("total_ms")), width=1000).collect()
    assert len(fps) == 40_000 and all(r.fps == pytest.approx(100.0) for r in fps)


def test_latency_figures_equal_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [("a" if i % 3 else "b", 1, i, float(np.round(rng.gamma(2.0, 5.0), 2))) for i in range(500)]
    out = {r.stage: r for r in T.latency_stats(spark.createDataFrame(rows, "stage string, batch int, run bigint, ms double"), 20).collect()}
    for stage in "ab":
        ms = [r[3] for r in rows if r[0] == stage][20:]
        assert out[stage].n == len(ms) and out[stage].median == pytest.approx(np.median(ms)) and out[stage].p95 == pytest.approx(np.percentile(ms, 95))
        assert (out[stage].min, out[stage].max) == (min(ms), max(ms)) and out[stage].mean == pytest.approx(np.mean(ms))
    short = spark.createDataFrame([("c", 1, i, 1.0) for i in range(5)], "stage string, batch int, run bigint, ms double")
    assert T.latency_stats(short, 20).count() == 0


def test_reports_at_given_thresholds_and_their_refusals(spark, sf):
    scored = evaluation._scored(spark, sf)
    row = E.evaluate(scored, thresholds=[0.2, 0.7, 0.2]).first()
    assert [p.threshold for p in row.points] == [0.2, 0.7]
    for p in row.points:
        at = E.operating_point(E.apcer_bpcer(scored, p.threshold)).first()
        assert (p.bpcer, p.worst_apcer) == (pytest.approx(at.bpcer), pytest.approx(at.worst_apcer))
    with pytest.raises(ValueError, match="bona fide and attack"):
        E.evaluate(scored.filter("attack_type = 'print'"))
    parts = reports.test_report(scored, 0.45, "validation")
    assert parts["summary"].first().threshold_source == "validation" and parts["conditions"].count() == 4 and parts["fairness"].count() == 1
    assert [r.target for r in parts["targets"].orderBy("target").collect()] == [0.01, 0.05, 0.1]


def test_score_tables_of_arrays_and_their_errors(spark):
    a = spark.createDataFrame([(1, [0.1, 0.2]), (2, [0.3, 0.4])], "sample_id bigint, score array<double>")
    b = spark.createDataFrame([(1, [0.1, 0.20001]), (2, [0.3, 0.4])], "sample_id bigint, score array<double>")
    assert E.require_equal_scores(a, b).first().max_abs_diff == pytest.approx(1e-5)
    for wrong in ([(1, [0.1, 0.2])], [(1, [0.1, 0.2]), (2, [0.3])], [(1, [0.1, 0.2]), (2, [0.3, 0.5])], [(1, [0.1, 0.2]), (2, [0.3, 0.4]), (2, [0.3, 0.4])]):
        with pytest.raises(ValueError):
            E.require_equal_scores(a, spark.createDataFrame(wrong, a.schema))


def test_a_gallery_with_missing_parts_is_refused(spark, tmp_path):
    for k, bad in enumerate([("a", 1, None), (None, 1, [0.0] * 8), ("a", 1, [0.0] * 7)]):
        G.write_gallery(spark.createDataFrame([("b", 0, [1.0] * 8), bad], "name string, ordinal bigint, v array<double>"), f"{tmp_path}/{k}", 1)
        with pytest.raises(ValueError):
            G.read_gallery(spark, f"{tmp_path}/{k}", 8)
