"""Queries of geometry, detections, frames, trust and latency over ``lineitem``, ``events`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presentia.functions import geometry as G
from presentia.operators import frames as R
from presentia.operators import trust as T
from presentia.queries.adapters import adapted, duck, table

BOX = ("x1", "y1", "x2", "y2")
W, H = 110, 100


def _dets(spark: SparkSession, sf: str) -> DataFrame:
    return adapted(spark, sf, "detections")


def _faces(spark: SparkSession, sf: str) -> DataFrame:
    return adapted(spark, sf, "faces")


def b8_box_metrics(spark, sf):
    return G.box_metrics(_dets(spark, sf)).select("image_id", "cand_id", "width", "height", "area")


def b9_box_valid(spark, sf):
    bent = _dets(spark, sf).withColumn("x2", F.when(F.col("image_id") % 7 == 0, F.col("x1")).otherwise(F.col("x2"))).withColumn("score", F.col("score") + F.when(F.col("image_id") % 11 == 0, 1.0).otherwise(0.0))
    return bent.select("image_id", "cand_id", G.box_valid().alias("valid"))


def b10_box_scaled(spark, sf):
    return G.box_scaled(_dets(spark, sf), 0.01, 0.5).select("image_id", "cand_id", *BOX)


def b11_box_clipped(spark, sf):
    return G.box_clipped(_dets(spark, sf), W, H).select("image_id", "cand_id", *BOX)


def b12_crop_window(spark, sf):
    return G.crop_window(_dets(spark, sf), W, H).select("image_id", "cand_id", "cx1", "cy1", "cx2", "cy2", "empty")


def _cands(spark, sf):
    d = _dets(spark, sf)
    kps = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct((i * 0.5 + F.col("x1") % 3).cast("double").alias("x"), (F.col("y1") % 5 - i * 0.25).cast("double").alias("y")))
    grid = {"stride": F.element_at(F.array(F.lit(8), F.lit(16), F.lit(32)), (F.col("cand_id") % 3 + 1).cast("int")), "gx": F.col("x1"), "gy": F.col("y1"), "l": F.col("x1") / 8, "t": F.col("y1") / 16, "r": F.col("x2") / 32, "b": F.col("y2") / 32, "kps": kps}
    return d.select("image_id", "cand_id", "score", *[v.alias(k) for k, v in grid.items()])


def b13_decode_detections(spark, sf):
    out = G.decode_detections(_cands(spark, sf), 0.5)
    return out.select("image_id", "cand_id", *[F.round(k, 6).alias(k) for k in BOX], F.round(F.get("kps", F.lit(4))["x"], 6).alias("kx"), F.round(F.get("kps", F.lit(4))["y"], 6).alias("ky"))


def b14_finalize_detections(spark, sf):
    return G.finalize_detections(G.decode_detections(_cands(spark, sf), 0.5), 640, 480).select("image_id", "cand_id", *BOX, "score")


def b15_alignment_params(spark, sf):
    kps = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct(F.get("embedding", i * 2).cast("double").alias("x"), F.get("embedding", i * 2 + 1).cast("double").alias("y")))
    a = G.alignment_params(kps)
    return table(spark, sf, "embeddings").select("vec_id", *[F.round(a[k], 5).alias(k) for k in ("p", "q", "tx", "ty")])


def b24_augmentation_plan(spark, sf):
    plan = G.augmentation_plan(adapted(spark, sf, "manifest"), 2, 5)
    return plan.select("path", "epoch", "flip", "blur", *[F.round(k, 9).alias(k) for k in ("contrast", "brightness", "angle", "shift_x", "shift_y")], "jpeg_quality")


def d22_nms(spark, sf):
    return R.nms(_dets(spark, sf)).select("image_id", "cand_id")


def e4_largest_face(spark, sf):
    return R.largest_face(_dets(spark, sf).withColumnRenamed("cand_id", "face_id"), ["image_id"])


def e5_capture_frames(spark, sf):
    return R.capture_frames(_dets(spark, sf), already=40).select("image_id", "boxes", "reason", F.col("number").cast("long").alias("number"))


def d25_thin_frames(spark, sf):
    usable = _faces(spark, sf).filter(T.enroll_reject_reason(640, 480, 0.5).isNull()).withColumn("who", F.col("vec_id") % 50)
    return R.thin_frames(usable, ["who", "camera"])


def e3_score_history(spark, sf):
    out = R.score_history(_faces(spark, sf))
    return out.select("face_id", "camera", "cell_x", "cell_y", F.col("tick").cast("long").alias("tick"), "n", F.round(F.col("mean_score") * F.col("n"), 4).alias("score_sum"))


def e6_rolling_fps(spark, sf):
    frames = _faces(spark, sf).select("camera", "frame_id", (F.col("detect_ms") + F.col("liveness_ms") + F.col("recognize_ms")).alias("total_ms"))
    return R.rolling_fps(frames).withColumn("fps", F.round("fps", 6))


def b19_resolve_threshold(spark, sf):
    o = F.when(F.col("run_id") % 3 == 0, F.lit(0.3))
    s = F.when(F.col("run_id") % 2 == 0, F.col("val_eer"))
    value, source = T.resolve_threshold(o, s)
    return adapted(spark, sf, "history").select("run_id", "epoch", value.alias("threshold"), source.alias("threshold_source"))


def b20_liveness_verdict(spark, sf):
    live = T.is_live(F.col("spoof_probability"), 0.5)
    return _faces(spark, sf).select("face_id", live.alias("is_live"), F.when(live, "REAL").when(~live, "SPOOF").alias("verdict"))


def b21_trust_status(spark, sf):
    live, name = T.is_live(F.col("spoof_probability"), 0.5), F.when(F.col("vec_id") % 3 == 0, F.lit("p"))
    status = T.trust_status(live, name)
    return _faces(spark, sf).select("face_id", status.alias("status"), T.hint(status).alias("hint"))


def b22_enroll_reject_reason(spark, sf):
    return _faces(spark, sf).select("face_id", T.enroll_reject_reason(500, 350, 0.5).alias("reason"))


def _shots(spark, sf):
    """A shot is six frames of all cameras, so often several of one; every seventh has no embedding."""
    return _faces(spark, sf).withColumn("shot", F.floor(F.col("frame_id") / 6)).withColumn("vec_id", F.when(F.col("face_id") % 7 > 0, F.col("vec_id")))


def b23_enroll_guard(spark, sf):
    return T.enroll_guard(_shots(spark, sf), ["camera", "shot"], 0.5)


def _recognized(spark, sf):
    return T.recognize(_faces(spark, sf), adapted(spark, sf, "probes").withColumnRenamed("probe_id", "vec_id"), adapted(spark, sf, "gallery"), 0.5)


def c3_recognize(spark, sf):
    return _recognized(spark, sf).select("face_id", "name", F.round("similarity", 6).alias("similarity"), "is_live", "status")


def d21_frame_summary(spark, sf):
    faces = _recognized(spark, sf).withColumn("shot", F.floor(F.col("frame_id") / 12))
    return T.frame_summary(faces, ["camera", "shot"]).select("camera", "shot", "faces", "trusted", "spoofs", F.round("total_ms", 6).alias("total_ms"), F.round("fps", 6).alias("fps"))


def j6_identify_batch_job(spark, sf):
    return _recognized(spark, sf).groupBy("camera", "status").agg(F.count(F.lit(1)).alias("faces"), F.count("name").alias("named"))


def e7_drop_warmup(spark, sf):
    return T.drop_warmup(adapted(spark, sf, "latency"), 30, ["stage", "batch"]).select("stage", "batch", F.col("run").cast("long").alias("run"))


def d19_latency_stats(spark, sf):
    return T.latency_stats(adapted(spark, sf, "latency"), 20).select("stage", "batch", "n", *[F.round(k, 6).alias(k) for k in ("median", "p95", "min", "max", "mean", "fps")], F.round("per_item", 9).alias("per_item"))


STAGES = ("view", "click", "purchase", "no_such_stage")


def d20_end_to_end(spark, sf):
    out = T.end_to_end(T.latency_stats(adapted(spark, sf, "latency"), 20), STAGES)
    return out.select("batch", F.round("total_ms", 6).alias("total_ms"), F.round("fps", 6).alias("fps"), "missing")


DE, FA = duck("detections"), duck("faces")
CLIP = "least(greatest(x1, 0), {w} - 2)::int as x1, least(greatest(y1, 0), {h} - 2)::int as y1, least(greatest(x2, 1), {w} - 1)::int as x2, least(greatest(y2, 1), {h} - 1)::int as y2"
CANDS = "cd as (select *, [8, 16, 32][cand_id % 3 + 1] as stride, x1 as gx, y1 as gy, x1 / 8 as l, y1 / 16 as t, x2 / 32 as r, y2 / 32 as b, 2.0 + x1 % 3 as k4x, y1 % 5 - 1.0 as k4y from detections), dd as (select image_id, cand_id, score, (gx * stride - l * stride) / 0.5 as x1, (gy * stride - t * stride) / 0.5 as y1, (gx * stride + r * stride) / 0.5 as x2, (gy * stride + b * stride) / 0.5 as y2, (k4x * stride + gx * stride) / 0.5 as kx, (k4y * stride + gy * stride) / 0.5 as ky from cd where score >= 0.5)"
_T = G.TEMPLATE
_TX, _TY = sum(x for x, _ in _T) / 5, sum(y for _, y in _T) / 5
_X, _Y = [f"embedding[{2 * i + 1}]::double" for i in range(5)], [f"embedding[{2 * i + 2}]::double" for i in range(5)]
_SX, _SY = f"(({' + '.join(_X)}) / 5)", f"(({' + '.join(_Y)}) / 5)"
_VAR = " + ".join(f"({x} - sx) * ({x} - sx) + ({y} - sy) * ({y} - sy)" for x, y in zip(_X, _Y, strict=True))
_DOT = " + ".join(f"({x} - sx) * ({u - _TX}) + ({y} - sy) * ({v - _TY})" for x, y, (u, v) in zip(_X, _Y, _T, strict=True))
_CROSS = " + ".join(f"({x} - sx) * ({v - _TY}) - ({y} - sy) * ({u - _TX})" for x, y, (u, v) in zip(_X, _Y, _T, strict=True))
REJECT = "case when x1 is null then 'no_face' when least(x2 - x1, y2 - y1) < 110 then 'too_small' when x1 >= {w} or y1 >= {h} or x2 <= 0 or y2 <= 0 then 'out_of_frame' when sharpness < 40 then 'too_blurry' when spoof_probability >= 0.5 then 'liveness_rejected' end"
U = "cast(('0x' || substr(md5('5:' || epoch || ':' || path || ':{slot}'), 1, 8)) as bigint) / 4294967296.0::double"
UNIT = "list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-10))"
RECOG = f"""gu as (select name, ordinal, {UNIT} as v from (select name, ordinal, v::double[] as v from gallery)), pu as (select probe_id as vec_id, {UNIT} as v from probes),
bm as (select vec_id, max(struct_pack(s := round(list_dot_product(pu.v, gu.v), 6), o := -ordinal, n := name)) as m from pu, gu group by vec_id),
rc as (select f.*, spoof_probability < 0.5 as is_live, case when spoof_probability is null or spoof_probability < 0.5 then m.s end as similarity, case when (spoof_probability is null or spoof_probability < 0.5) and m.s >= 0.36 then m.n end as name from faces f left join bm using (vec_id)),
rg as (select *, case when not is_live then 'SPOOF' when is_live is null then 'UNVERIFIED' when name is not null then 'TRUSTED' else 'UNKNOWN' end as status from rc)"""
RS = duck("faces", "gallery", "probes")
LA = duck("latency")
LAT = "lk as (select * from (select *, row_number() over (partition by stage, batch order by run) as n from latency) where n > 20), ls as (select stage, batch, count(*) as n, quantile_cont(ms, 0.5) as median, quantile_cont(ms, 0.95) as p95, min(ms) as min, max(ms) as max, avg(ms) as mean from lk group by stage, batch)"
HIST = "tk as (select *, floor((x1 + x2) / 2 / 120)::int as cell_x, floor((y1 + y2) / 2 / 120)::int as cell_y, row_number() over (partition by camera order by frame_id, face_id) as tick from faces where spoof_probability is not null), gp as (select *, coalesce((tick - lag(tick) over (partition by camera, cell_x, cell_y order by tick) > 121)::int, 0) as restart from tk), rn as (select *, sum(restart) over (partition by camera, cell_x, cell_y order by tick rows unbounded preceding) as run from gp)"
IOU = "(greatest(least(q.x2, c.x2) - greatest(q.x1, c.x1) + 1, 0) * greatest(least(q.y2, c.y2) - greatest(q.y1, c.y1) + 1, 0))::double"
NMS = """with recursive detections as materialized ({det}), rk as materialized (select *, row_number() over (partition by image_id order by score desc, cand_id) as rn from detections),
st as (select image_id, 0::bigint as k, [] :: struct(cand_id bigint, x1 int, y1 int, x2 int, y2 int)[] as kept from (select distinct image_id from rk)
union all select st.image_id, k + 1, case when len(list_filter(kept, lambda q: {iou} / ((q.x2 - q.x1 + 1) * (q.y2 - q.y1 + 1) + (c.x2 - c.x1 + 1) * (c.y2 - c.y1 + 1) - {iou}) > 0.4)) > 0 then kept else list_append(kept, struct_pack(cand_id := c.cand_id::bigint, x1 := c.x1, y1 := c.y1, x2 := c.x2, y2 := c.y2)) end from st join rk c on c.image_id = st.image_id and c.rn = k + 1)
select image_id, unnest(kept).cand_id as cand_id from (select image_id, arg_max(kept, k) as kept from st group by image_id)"""
THIN = """with recursive faces as materialized ({faces}), us as materialized (select vec_id % 50 as who, camera, frame_id from faces where ({reject}) is null),
ch as (select who, camera, min(frame_id) as frame_id, 1 as n from us group by who, camera
union all select who, camera, nxt, n + 1 from (select ch.who, ch.camera, (select min(u.frame_id) from us u where u.who = ch.who and u.camera = ch.camera and u.frame_id >= ch.frame_id + 12) as nxt, n from ch where n < 8) where nxt is not null)
select who, camera, frame_id from ch"""
_HINT = " ".join(f"when '{k}' then '{v}'" for k, v in T.HINTS.items())
SQL = {
    "b8_box_metrics": f"{DE} select image_id, cand_id, x2 - x1 as width, y2 - y1 as height, (x2 - x1) * (y2 - y1) as area from detections",
    "b9_box_valid": f"{DE} select image_id, cand_id, image_id % 7 <> 0 and x2 > x1 and y2 > y1 and score + case when image_id % 11 = 0 then 1 else 0 end between 0 and 1 as valid from detections",
    "b10_box_scaled": f"{DE}, s as (select image_id, cand_id, trunc(x1 * 0.01::double)::int as x1, trunc(y1 * 0.5::double)::int as y1, trunc(x2 * 0.01::double)::int as x2, trunc(y2 * 0.5::double)::int as y2 from detections) select image_id, cand_id, x1, y1, greatest(x2, x1 + 1) as x2, greatest(y2, y1 + 1) as y2 from s",
    "b11_box_clipped": f"{DE} select image_id, cand_id, {CLIP.format(w=W, h=H)} from detections",
    "b12_crop_window": f"{DE}, s as (select *, trunc((x2 - x1) * 0.3::double)::int as mx, trunc((y2 - y1) * 0.3::double)::int as my from detections), w as (select image_id, cand_id, greatest(x1 - mx, 0) as cx1, greatest(y1 - my, 0) as cy1, least(x2 + mx, {W}) as cx2, least(y2 + my, {H}) as cy2 from s) select *, cx2 <= cx1 or cy2 <= cy1 as empty from w",
    "b13_decode_detections": f"{DE}, {CANDS} select image_id, cand_id, {', '.join(f'round({k}, 6) as {k}' for k in BOX)}, round(kx, 6) as kx, round(ky, 6) as ky from dd",
    "b14_finalize_detections": f"{DE}, {CANDS}, f as (select image_id, cand_id, trunc(x1)::int as x1, trunc(y1)::int as y1, trunc(x2)::int as x2, trunc(y2)::int as y2, least(greatest(score, 0), 1) as score from dd where x2 - x1 >= 2 and y2 - y1 >= 2) select image_id, cand_id, {CLIP.format(w=640, h=480)}, score from f",
    "b15_alignment_params": f"with s as (select *, {_SX} as sx, {_SY} as sy from embeddings), m as (select vec_id, sx, sy, ({_DOT}) / ({_VAR}) as p, ({_CROSS}) / ({_VAR}) as q from s) select vec_id, round(p, 5) as p, round(q, 5) as q, round({_TX} - (p * sx - q * sy), 5) as tx, round({_TY} - (q * sx + p * sy), 5) as ty from m",
    "b24_augmentation_plan": f"{duck('manifest')}, r as (select path, unnest([0, 1])::int as epoch from manifest), u as (select path, epoch, {', '.join(U.format(slot=s) + f' as u_{s}' for s in ('flip', 'tone', 'turn', 'contrast', 'brightness', 'angle', 'shift_x', 'shift_y', 'jpeg', 'quality', 'blur'))} from r) select path, epoch, u_flip < 0.5 as flip, u_blur < 0.15 as blur, case when u_tone < 0.7 then round(1.0::double + 0.4::double * u_contrast - 0.2::double, 9) end as contrast, case when u_tone < 0.7 then round(40 * u_brightness - 20, 9) end as brightness, case when u_turn < 0.5 then round(16 * u_angle - 8, 9) end as angle, case when u_turn < 0.5 then round((0.08::double * u_shift_x - 0.04::double) * 112, 9) end as shift_x, case when u_turn < 0.5 then round((0.08::double * u_shift_y - 0.04::double) * 112, 9) end as shift_y, case when u_jpeg < 0.3 then floor(45 + 50 * u_quality)::bigint end as jpeg_quality from u",
    "d22_nms": NMS.format(det=duck("detections").removeprefix("with detections as (")[:-1], iou=IOU),
    "e4_largest_face": f"{DE} select image_id, m.i as face_id, m.a as area from (select image_id, arg_max(struct_pack(i := cand_id, a := (x2 - x1)::bigint * (y2 - y1)), struct_pack(a := (x2 - x1)::bigint * (y2 - y1), o := -cand_id)) as m from detections group by image_id)",
    "e5_capture_frames": f"{DE}, f as (select image_id, count(*) as boxes, min(least(x2 - x1, y2 - y1)) as side from detections group by image_id), j as (select *, case when boxes > 1 then 'several_faces' when side < 80 then 'too_small' when image_id % 3 <> 0 then 'between_strides' end as reason from f), n as (select image_id, row_number() over (order by image_id) as k from j where reason is null) select j.image_id, boxes, case when reason is null and k > 100 then 'target_reached' else reason end as reason, case when k <= 100 then k + 40 end as number from j left join n using (image_id)",
    "d25_thin_frames": THIN.format(faces=duck("faces").removeprefix("with faces as (")[:-1], reject=REJECT.format(w=640, h=480)),
    "e3_score_history": f"{FA}, {HIST} select face_id, camera, cell_x, cell_y, tick, count(*) over w as n, round(sum(spoof_probability) over w, 4) as score_sum from rn window w as (partition by camera, cell_x, cell_y, run order by tick rows between 119 preceding and current row)",
    "e6_rolling_fps": f"{FA}, t as (select camera, frame_id, detect_ms + liveness_ms + recognize_ms as ms from faces) select camera, frame_id, round(case when sum(ms) over w > 0 then count(*) over w / (sum(ms) over w / 1000) else 0 end, 6) as fps from t window w as (partition by camera order by frame_id rows between 29 preceding and current row)",
    "b19_resolve_threshold": f"{duck('history')} select run_id, epoch, case when run_id % 3 = 0 then 0.3::double when run_id % 2 = 0 then val_eer else 0.5 end as threshold, case when run_id % 3 = 0 then 'override' when run_id % 2 = 0 then 'validation' else 'default' end as threshold_source from history",
    "b20_liveness_verdict": f"{FA} select face_id, spoof_probability < 0.5 as is_live, case when spoof_probability < 0.5 then 'REAL' when spoof_probability >= 0.5 then 'SPOOF' end as verdict from faces",
    "b21_trust_status": f"{FA}, s as (select face_id, case when spoof_probability >= 0.5 then 'SPOOF' when spoof_probability is null then 'UNVERIFIED' when vec_id % 3 = 0 then 'TRUSTED' else 'UNKNOWN' end as status from faces) select face_id, status, case status {_HINT} end as hint from s",
    "b22_enroll_reject_reason": f"{FA} select face_id, {REJECT.format(w=500, h=350)} as reason from faces",
    "b23_enroll_guard": f"{FA}, g as (select camera, floor(frame_id / 6)::bigint as shot, count(*) as faces, max(spoof_probability) as p, max(case when face_id % 7 > 0 then vec_id end) as vec_id from faces group by all) select camera, shot, faces, case when faces > 1 then 'several_faces' when p is null or p >= 0.5 then 'not_live' when vec_id is null then 'no_embedding' end as reason from g",
    "c3_recognize": f"{RS}, {RECOG} select face_id, name, similarity, is_live, status from rg",
    "d21_frame_summary": f"{RS}, {RECOG}, s as (select camera, floor(frame_id / 12)::bigint as shot, count(*) as faces, count(*) filter (where status = 'TRUSTED') as trusted, count(*) filter (where status = 'SPOOF') as spoofs, max(detect_ms + liveness_ms + recognize_ms) as ms from rg group by all) select camera, shot, faces, trusted, spoofs, round(ms, 6) as total_ms, round(case when ms > 0 then 1000 / ms else 0 end, 6) as fps from s",
    "j6_identify_batch_job": f"{RS}, {RECOG} select camera, status, count(*) as faces, count(name) as named from rg group by camera, status",
    "e7_drop_warmup": f"{LA} select stage, batch, run from (select *, row_number() over (partition by stage, batch order by run) as n from latency) where n > 30",
    "d19_latency_stats": f"{LA}, {LAT} select stage, batch, n, {', '.join(f'round({k}, 6) as {k}' for k in ('median', 'p95', 'min', 'max', 'mean'))}, round(case when median > 0 then 1000 / median else 0 end, 6) as fps, round(median / batch, 9) as per_item from ls",
    "d20_end_to_end": f"{LA}, {LAT} select batch, round(sum(median), 6) as total_ms, round(1000 / sum(median), 6) as fps, 'no_such_stage' as missing from ls where stage in ('view', 'click', 'purchase') group by batch",
}
QUERIES = {k: v for k, v in list(globals().items()) if k in SQL}
