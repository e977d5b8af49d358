"""Queries of models, streams and end-to-end jobs."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presentia.operators import evaluation as E
from presentia.operators import galleries as G
from presentia.operators import models as M
from presentia.operators import reports as R
from presentia.operators import splits as S
from presentia.plans.materialize import materialize, scratch_path
from presentia.queries.adapters import adapted, duck, table
from presentia.queries.evaluation import EER, REPORT, _r, _scored, curve_sql, r9, report_sql
from presentia.queries.ingest import _split_sql
from presentia.queries.galleries import enrolled_sql
from presentia.queries.serving import REJECT
from presentia.queries.serving import SQL as SERVING_SQL
from presentia.streaming import faces as ST


def _features(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as samples: label 0 is bona fide, each id a subject."""
    e = table(spark, sf, "embeddings")
    kind = F.when(F.col("label") == 0, "bona_fide").when(F.col("label") % 2 == 0, "print").otherwise("replay")
    return e.select(F.col("vec_id").alias("sample_id"), F.concat(F.lit("s"), F.col("vec_id").cast("string")).alias("subject"), F.lit("d0").alias("session"), kind.alias("attack_type"), F.col("embedding").cast("array<double>").alias("v"))


def _first_half():
    """A user model: the share of weight in the first half of a vector."""

    def predict(x: np.ndarray) -> np.ndarray:
        a = np.abs(x)
        return a[:, : x.shape[1] // 2].sum(axis=1) / a.sum(axis=1)

    return predict


def i1_score_with(spark, sf):
    return M.score_with(_features(spark, sf), _first_half, "v", 64, "score").select("sample_id", F.round("score", 6).alias("score"))


def _trained(spark: SparkSession, sf: str) -> str:
    """Trains a scorer on a leak-free split and saves the run; where it is."""
    split = materialize(S.group_split(_features(spark, sf), seed=3), "split")
    if not S.split_integrity(split).isEmpty():
        raise ValueError("the split leaks")
    val = split.filter("split = 'val'")
    model, records = M.fit_scorer(split.filter("split = 'train'"), val)
    path = scratch_path(spark, "run")
    M.save_run(path, model, records, split, M.spoof_scores(model, val))
    return path


def _tested(spark: SparkSession, sf: str, run: M.Run) -> DataFrame:
    """Scores of the test groups by a saved run, of a split that is made again and verified against the run's fingerprint."""
    split = materialize(S.group_split(_features(spark, sf), seed=3), "split")
    return M.spoof_scores(run.model, _verified(split, run))


def _verified(split: DataFrame, run: M.Run) -> DataFrame:
    """The test rows of ``split``; raises if they are not those of the run."""
    test = split.filter("split = 'test'")
    found = S.verify_split(run.fingerprint, test, run.split_by).first()
    if found["status"] != "verified":
        raise ValueError(f"the split is not the recorded one: {found.asDict()}")
    return test


def i2_fit_scorer(spark, sf):
    run = M.load_run(spark, _trained(spark, sf))
    split = S.group_split(_features(spark, sf), seed=3)
    return M.spoof_scores(run.model, split).select("sample_id", "split", "attack_type", "score", F.lit(run.threshold).alias("threshold"))


def d24_select_checkpoint(spark, sf):
    return M.select_checkpoint(adapted(spark, sf, "history"))


def j2_train_and_report(spark, sf):
    run = M.load_run(spark, _trained(spark, sf))
    return R.headline(E.evaluate_at(_tested(spark, sf, run), run.threshold))


def j3_eval_saved_scorer(spark, sf):
    """The parts of the test report of a saved run, from what the run has stored."""
    run = M.load_run(spark, _trained(spark, sf))
    parts = R.test_report(_tested(spark, sf, run).withColumn("conditions", F.create_map().cast("map<string,string>")), run.threshold, "validation EER")
    return parts["summary"].select("n_bona_fide", "n_attack", "threshold_source", *REPORT)


def _recorded(spark: SparkSession, sf: str, seed: int = 7) -> M.Run:
    """A run over given scores: its threshold is the EER point of the validation groups; saved and read again."""
    split = materialize(S.group_split(_scored(spark, sf), seed=seed), "split")
    val = split.filter("split = 'val'")
    e = E.eer_of(E.curve(val)).first()
    path = scratch_path(spark, "run")
    M.save_run(path, None, [{"reg": 0.0, "val_eer": e["eer"], "threshold": e["eer_threshold"], "loss": 0.0}], split, val)
    return M.load_run(spark, path)


def _held_out(spark: SparkSession, sf: str, run: M.Run, seed: int = 7) -> DataFrame:
    """Scores of the test groups of a split that is made again and verified against the run's fingerprint."""
    scored = _scored(spark, sf)
    test = _verified(materialize(S.group_split(scored, seed=seed), "split"), run)
    asked = test.select("sample_id")  # the scorer answers for the test samples
    return materialize(E.join_scores(test.drop("score"), scored.join(asked, "sample_id", "left_semi").select("sample_id", "score")), "held-out")


def j3_eval_held_out(spark, sf):
    run = _recorded(spark, sf)
    report = R.headline(E.evaluate_at(_held_out(spark, sf, run), run.threshold))
    return report.select("n_bona_fide", "n_attack", "note", *[r9(c) for c in REPORT])


def j4_eval_cross(spark, sf):
    """The held-out events against all rows of ``lineitem``, at the threshold that the run has stored."""
    run = _recorded(spark, sf)
    out = E.cross_dataset(E.evaluate_at(_held_out(spark, sf, run), run.threshold), E.evaluate_at(adapted(spark, sf, "scored_big"), run.threshold))
    return out.select("metric", r9("source"), r9("target"), r9("delta"), "direction", "verdict")


#: Rows of a replayed file, about, and so many of the smallest arrival that each of its files gets some.
FILE_ROWS, LEAST_FILE_ROWS = 250_000, 1000


def _stream(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Faces as a stream of four arrivals in time order, each a quarter of the time span, and the same as a table.

    Each arrival has equally many files, which tasks write side by side, and a batch of the stream takes as many.
    """
    path = scratch_path(spark, "faces")
    faces = adapted(spark, sf, "faces").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("camera", F.col("camera").cast("bigint"))
    at = F.unix_micros("ts")
    first, last = faces.agg(F.min(at), F.max(at)).first()
    cuts = [None, *([] if first is None else [first + (last - first) * k // 4 for k in (1, 2, 3)]), None]
    parts = [faces.filter((F.lit(lo is None) | (at >= F.lit(lo))) & (F.lit(hi is None) | (at < F.lit(hi)))) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    rows = faces.agg(*[F.count_if((F.lit(lo is None) | (at >= F.lit(lo))) & (F.lit(hi is None) | (at < F.lit(hi)))) for lo, hi in zip(cuts, cuts[1:], strict=False)]).first()
    files = max(1, -(-max(rows) // FILE_ROWS))
    if min(rows) < LEAST_FILE_ROWS * files:  # too few rows to be sure of one for each file
        files = 1
    for part in parts:  # one after another: a file stream reads by arrival
        dealt = part.coalesce(1) if files == 1 else part.repartition(files)
        dealt.sortWithinPartitions("ts").write.mode("append").parquet(path)
    still = spark.read.schema(faces.schema).parquet(path)
    if files > 1 and len(still.inputFiles()) != files * len(parts):
        raise ValueError("an arrival has a file too few")
    return ST.read_faces(spark, path, still.schema, files), still


def _collected(spark: SparkSession, out: DataFrame) -> DataFrame:
    sink, ck = scratch_path(spark, "sink"), scratch_path(spark, "offsets")
    q = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)


def h1_stream_trust(spark, sf):
    stream, _ = _stream(spark, sf)
    sink = scratch_path(spark, "trust")
    probes = adapted(spark, sf, "probes").withColumnRenamed("probe_id", "vec_id")
    ST.stream_trust(stream, probes, adapted(spark, sf, "gallery"), 0.5, sink, scratch_path(spark, "offsets")).awaitTermination()
    return spark.read.parquet(sink).select("face_id", "name", F.round("similarity", 6).alias("similarity"), "is_live", "status")


@contextmanager
def _rocksdb(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def h2_stream_score_history(spark, sf):
    stream, _ = _stream(spark, sf)
    with _rocksdb(spark):
        return _collected(spark, ST.stream_score_history(stream, ttl_ms=24 * 3600 * 1000)).withColumn("mean_score", F.round("mean_score", 10))


def h3_stream_enroll(spark, sf):
    stream, _ = _stream(spark, sf)
    root = scratch_path(spark, "live-gallery")
    G.write_gallery(adapted(spark, sf, "gallery"), root, 0)
    probes = adapted(spark, sf, "probes").select(F.col("probe_id").alias("vec_id"), "v")
    named = stream.withColumn("name", F.concat(F.lit("p"), (F.col("vec_id") % 10).cast("string")))
    with _rocksdb(spark):
        ST.stream_enroll(named, probes, root, 64, 0.5, (640, 480), scratch_path(spark, "offsets")).awaitTermination()
    return G.gallery_summary(G.read_gallery(spark, root, 64))


def h4_stream_frame_stats(spark, sf):
    out = _collected(spark, ST.frame_stats(_stream(spark, sf)[0]))
    return out.select("camera", *_stamped(), "faces", F.round("detect_ms", 10).alias("detect_ms"), F.round("liveness_ms", 10).alias("liveness_ms"), "recognize_ms")


def _stamped() -> list[Column]:
    """start and end as text."""
    return [F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("start", "end")]


def h5_stream_presence(spark, sf):
    return _collected(spark, ST.presence(_stream(spark, sf)[0])).select("camera", "cell_x", "cell_y", *_stamped(), "faces")


def h5_presence_batch(spark, sf):
    faces = adapted(spark, sf, "faces").withColumn("ts", F.col("ts").cast("timestamp"))
    return ST.presence(faces).select("camera", "cell_x", "cell_y", *_stamped(), "faces")


def h6_stream_capture(spark, sf):
    stream, _ = _stream(spark, sf)
    sink = scratch_path(spark, "captured")
    ST.stream_capture(stream, sink, scratch_path(spark, "offsets"), target=500).awaitTermination()
    return spark.read.parquet(sink).select("camera", "frame_id", "face_id")


SPLIT = _split_sql().replace("manifest", "scored")
STORED = "(select t from stored)"
#: The held-out rows and the threshold stored with their run: the EER point of the validation rows.
HELD = f"{SPLIT}, held as (select * from spl where split = 'test'), val as (select * from spl where split = 'val'), {curve_sql('val')}, stored as (select {EER}.t as t)"
CELLS = "floor((x1 + x2) / 2 / 120)::int as cell_x, floor((y1 + y2) / 2 / 120)::int as cell_y"
STAMPED = "strftime({start}, '%Y-%m-%d %H:%M:%S.%f') as start, strftime({end}, '%Y-%m-%d %H:%M:%S.%f') as \"end\""
#: Faces with the number of the batch in which their file arrives.
ARRIVED = f"""{duck('faces')}, sp as (select min(epoch_us(ts)) as lo, max(epoch_us(ts)) as hi from faces),
ar as (select f.*, {' + '.join(f'(epoch_us(ts) >= lo + (hi - lo) * {k} // 4)::int' for k in (1, 2, 3))} as batch from faces f, sp)"""
#: What a stream has closed when it ends: its watermark follows the newest row.
CLOSED = "epoch_ms({end}) <= (select epoch_ms(max(ts)) from faces) - {hours} * 3600000"
SESSIONS = f"""{duck('faces')}, c as (select *, {CELLS} from faces), n as (select *, coalesce((ts > lag(ts) over w + interval 6 hour)::int, 1) as fresh from c window w as (partition by camera, cell_x, cell_y order by ts, face_id)),
s as (select *, sum(fresh) over (partition by camera, cell_x, cell_y order by ts, face_id rows unbounded preceding) as k from n),
se as (select camera, cell_x, cell_y, min(ts) as start, max(ts) + interval 6 hour as until, count(*) as faces from s group by camera, cell_x, cell_y, k)"""
#: Rows that the enrolment stream accepts: alone in their frame, usable, 12 frames after the last of their camera and name.
ACCEPTED = f"""us as materialized (select *, row_number() over (partition by camera, name order by batch, frame_id, face_id) as rn
from (select *, count(*) over (partition by batch, camera, frame_id) as alone, 'p' || (vec_id % 10) as name from ar) where alone = 1 and spoof_probability < 0.5 and vec_id is not null and ({REJECT.format(w=640, h=480)}) is null),
ac as (select distinct camera, name, 0::bigint as k, null::bigint as last, false as took, 0 as batch, 0::bigint as face_id, 0::bigint as vec_id from us
union all select a.camera, a.name, u.rn, case when coalesce(u.frame_id - a.last >= 12, true) then u.frame_id else a.last end, coalesce(u.frame_id - a.last >= 12, true), u.batch, u.face_id, u.vec_id
from ac a join us u on u.camera = a.camera and u.name = a.name and u.rn = a.k + 1)"""
#: Of rows with one vector only the first can be taken: the others are its copies, or copies of what it is a copy of.
NEW_FRAMES = "select a.name, row_number() over (order by a.batch, a.face_id) as arrival, p.v from (select * from ac where took qualify row_number() over (partition by name, vec_id order by batch, face_id) = 1) a join probes p on p.probe_id = a.vec_id"
SQL = {
    # A replayed stream gives what the batch operator gives.
    "h1_stream_trust": SERVING_SQL["c3_recognize"],
    "i1_score_with": "select vec_id as sample_id, round(list_sum(list_transform(embedding[1:len(embedding) // 2], lambda x: abs(x::double))) / list_sum(list_transform(embedding, lambda x: abs(x::double))), 6) as score from embeddings",
    "d24_select_checkpoint": f"""with recursive h as materialized ({duck('history').removeprefix('with history as (')[:-1]}),
st as (select distinct run_id, -1::bigint as seen, -1::bigint as best, 'inf'::double as eer, 'inf'::double as loss, 0 as misses, -1::bigint as last from h
union all select run_id, epoch::bigint, case when misses < 8 and better then epoch else best end, case when misses < 8 and better then val_eer else eer end, case when misses < 8 and better then val_loss else loss end,
case when misses >= 8 then misses when better then 0 else misses + 1 end, case when misses >= 8 then last else epoch end
from (select st.*, h.epoch, h.val_eer, h.val_loss, h.val_eer < eer - 1e-9 or (abs(h.val_eer - eer) <= 1e-9 and h.val_loss < loss) as better from st join h on h.run_id = st.run_id and h.epoch = st.seen + 1))
select run_id, m.b as best_epoch, m.e as best_eer, m.l as stopped_at from (select run_id, arg_max(struct_pack(b := best, e := eer, l := last), seen) as m from st group by run_id)""",
    "j3_eval_held_out": f"{duck('scored')}, {HELD}, {report_sql('held', 'rep', STORED)} select n_bona_fide, n_attack, case when n_bona_fide + n_attack < 200 then 'small sample' else '' end as note, {_r(*REPORT)} from rep",
    "j4_eval_cross": f"""{duck('scored', 'scored_big')}, {HELD}, {report_sql('held', 'src', STORED)}, {report_sql('scored_big', 'tgt', STORED)},
l as (select m.metric, m.source, m.target, m.target - m.source as delta from (select unnest([{', '.join(f"struct_pack(metric := '{m}', source := src.{m}, target := tgt.{m})" for m in E.COMPARED)}]) as m from src, tgt)),
g as (select max(delta) filter (where metric = 'eer') as e, greatest(max(delta) filter (where metric = 'worst_apcer'), max(delta) filter (where metric = 'bpcer')) as o from l)
select metric, {_r('source', 'target', 'delta')}, case when abs(delta) < 1e-9 then '=' when (delta > 0) = (metric = 'auc') then 'better' else 'worse' end as direction,
case when e > 0.10 then 'discrimination_collapse' when o > 0.10 then 'threshold_did_not_transfer' when e > 0.03 or o > 0.03 then 'moderate' else 'small' end as verdict from l, g""",
    "h2_stream_score_history": f"""{ARRIVED}, tk as (select *, {CELLS}, epoch_ms(ts) as ms from ar where spoof_probability is not null),
gp as (select *, coalesce((ms - lag(ms) over (partition by camera, cell_x, cell_y order by batch, ms, face_id) > 86400000)::int, 0) as restart from tk),
rn as (select *, sum(restart) over (partition by camera, cell_x, cell_y order by batch, ms, face_id rows unbounded preceding) as run from gp)
select camera, cell_x, cell_y, face_id, count(*) over w as n, round(avg(spoof_probability) over w, 10) as mean_score from rn window w as (partition by camera, cell_x, cell_y, run order by batch, ms, face_id rows between 119 preceding and current row)""",
    "h3_stream_enroll": f"""{ARRIVED.replace('with ', 'with recursive ', 1)}, {duck('gallery', 'probes').removeprefix('with ')}, {ACCEPTED}, {enrolled_sql(NEW_FRAMES)},
tt as (select name, count(*) as n from gallery group by name union all select name, max(kept) from st group by name) select name, sum(n)::bigint as samples from tt group by name having sum(n) > 0""",
    "h4_stream_frame_stats": f"""{duck('faces')}, w as (select *, time_bucket(interval 1 hour, ts) as start from faces)
select camera, {STAMPED.format(start='start', end='start + interval 1 hour')}, count(*) as faces, round(avg(detect_ms), 10) as detect_ms, round(avg(liveness_ms), 10) as liveness_ms, quantile_disc(recognize_ms, 0.5) as recognize_ms
from w where {CLOSED.format(end='start + interval 1 hour', hours=1)} group by camera, w.start""",
    "h5_stream_presence": f"{SESSIONS} select camera, cell_x, cell_y, {STAMPED.format(start='start', end='until')}, faces from se where {CLOSED.format(end='until', hours=6)}",
    "h5_presence_batch": f"{SESSIONS} select camera, cell_x, cell_y, {STAMPED.format(start='start', end='until')}, faces from se",
    "h6_stream_capture": f"{ARRIVED}, c as (select *, row_number() over (order by batch, frame_id, camera) as k from ar where frame_id % 3 = 0 and least(x2 - x1, y2 - y1) >= 80) select camera, frame_id, face_id from c where k <= 500",
}
QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and k[:1] in "dhij" and k[1:2].isdigit()}
