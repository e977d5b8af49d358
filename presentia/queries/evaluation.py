"""Queries of the evaluation operators over ``events`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presentia.operators import evaluation as E
from presentia.operators import reports as R
from presentia.queries.adapters import adapted, duck

THRESHOLD = 0.45


def r9(c: str | Column, name: str | None = None) -> Column:
    """Rounded to nine places."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 9).alias(name or c)


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    d = adapted(spark, sf, "scored")
    conditions = F.map_filter(F.create_map(F.lit("illumination"), "illumination", F.lit("attr:Eyeglasses"), "attr_eyeglasses"), lambda k, v: v.isNotNull())
    return d.withColumn("conditions", conditions)


def _big(spark: SparkSession, sf: str) -> DataFrame:
    return adapted(spark, sf, "scored_big")


def d1_validate_scores(spark, sf):
    return E.validate_scores(_scored(spark, sf))


def d2_apcer_bpcer(spark, sf):
    return E.apcer_bpcer(_scored(spark, sf), THRESHOLD).select("attack_type", "n", r9("rate"))


def d3_operating_point(spark, sf):
    point = E.operating_point(E.apcer_bpcer(_scored(spark, sf), THRESHOLD, ["session"]), ["session"])
    return point.select("session", "n_bona_fide", "n_attack", *[r9(c) for c in ("bpcer", "worst_apcer", "mean_apcer", "acer")])


def d4_roc(spark, sf):
    return E.roc(_scored(spark, sf)).select("threshold", r9("apcer"), r9("bpcer"))


def d5_eer(spark, sf):
    return E.eer_of(E.curve(_scored(spark, sf))).select(r9("eer"), r9("eer_threshold"))


def d6_auc(spark, sf):
    return E.auc_of(E.curve(_big(spark, sf), ["dataset"]), ["dataset"]).select("dataset", r9("auc"))


def d7_bpcer_at_apcer(spark, sf):
    points = E.curve(_scored(spark, sf))
    rows = [E.bpcer_at_apcer_of(points, t) for t in (0.01, 0.05, 0.10, 1.0)]
    out = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
    return out.select("target", r9("bpcer"), r9("threshold"), "threshold_clamped")


def d8_evaluate(spark, sf):
    out = E.evaluate(_big(spark, sf), ["dataset"])
    flat = out.select("dataset", "eer", "eer_threshold", "auc", "bpcer_at_0_01", "bpcer_at_0_05", "bpcer_at_0_10", "n_bona_fide", "n_attack", F.explode("points").alias("p"))
    return flat.select("dataset", "n_bona_fide", "n_attack", *[r9(c) for c in ("eer", "eer_threshold", "auc", "bpcer_at_0_01", "bpcer_at_0_05", "bpcer_at_0_10")], *[r9(F.col(f"p.{c}"), c) for c in ("threshold", "bpcer", "worst_apcer", "mean_apcer", "acer")])


REPORT = ("bpcer", "worst_apcer", "mean_apcer", "acer", "eer", "eer_threshold", "auc", "bpcer_at_0_01", "bpcer_at_0_05", "bpcer_at_0_10", "threshold")


def d9_evaluate_test(spark, sf):
    return R.headline(E.evaluate_at(_scored(spark, sf), THRESHOLD)).select("n_bona_fide", "n_attack", "note", *[r9(c) for c in REPORT])


def d9_evaluate_slices(spark, sf):
    """Reports of all rows, of sessions, of people with and without glasses, and of both together."""
    out = E.evaluate_slices(_scored(spark, sf), [[], ["session"], ["attr_eyeglasses"], ["session", "attr_eyeglasses"]], THRESHOLD)
    return out.select("slice", "n_bona_fide", "n_attack", *[r9(c) for c in REPORT])


def d10_stratify(spark, sf):
    return E.stratify(_scored(spark, sf), THRESHOLD).select("axis", "value", "n", "missed", r9("apcer"))


def d11_fairness_audit(spark, sf):
    audit = E.fairness_audit(E.fairness_groups(_scored(spark, sf), THRESHOLD))
    return audit.select("attribute", "rated", r9("worst"), r9("best"), r9("ratio"), r9("gap"), "flagged")


def d11_fairness_groups(spark, sf):
    return E.fairness_groups(_scored(spark, sf), THRESHOLD).select("attribute", "value", "n", "rejected", r9("bpcer"))


def f1_report_types(spark, sf):
    return R.type_rows(E.apcer_bpcer(_scored(spark, sf), THRESHOLD)).withColumn("apcer", F.round("apcer", 9))


def f1_report_conditions(spark, sf):
    return R.condition_rows(E.stratify(_scored(spark, sf), THRESHOLD)).withColumn("apcer", F.round("apcer", 9))


def f1_report_fairness(spark, sf):
    return R.fairness_rows(E.fairness_audit(E.fairness_groups(_scored(spark, sf), THRESHOLD))).withColumn("ratio", F.round("ratio", 9))


def f2_markdown_rows(spark, sf):
    scored = _scored(spark, sf)
    return R.markdown_rows(E.evaluate_at(scored, THRESHOLD), E.apcer_bpcer(scored, THRESHOLD))


def c4_verify_scores(spark, sf):
    pairs = adapted(spark, sf, "score_pair")
    out = E.verify_scores(pairs, 1e-4).withColumn("tolerance", F.lit(1e-4)).unionByName(E.verify_scores(pairs, 0.05).withColumn("tolerance", F.lit(0.05)))
    return out.select("tolerance", "n", "missing", r9("max_abs_diff"), "passed")


def c5_join_scores(spark, sf):
    scored = _scored(spark, sf)
    return E.join_scores(scored.select("sample_id", "subject", "attack_type"), scored.select("sample_id", "score"))


def c9_cross_dataset(spark, sf):
    scored = _scored(spark, sf)
    sides = [E.evaluate_at(scored.filter(F.col("sample_id") % 2 == k), THRESHOLD) for k in (0, 1)]
    return E.cross_dataset(*sides).select("metric", r9("source"), r9("target"), r9("delta"), "direction", "verdict")


def curve_sql(source: str, by: str = "") -> str:
    """hist and pts: the curve of ``source``, by an optional column."""
    sel, part, order = (f"{by}, ", f"partition by {by}", f"partition by {by} ") if by else ("", "", "")
    w = f"over ({order}order by score rows between unbounded preceding and 1 preceding)"
    return f"""hist as (select {sel}score, count(*) filter (where attack_type <> 'bona_fide') as a, count(*) filter (where attack_type = 'bona_fide') as b from {source} group by {sel}score),
cnt as (select {sel}score as value, a, b, coalesce(sum(a) {w}, 0) as below_a, coalesce(sum(b) {w}, 0) as below_b, sum(a) over ({part}) as n_a, sum(b) over ({part}) as n_b from hist),
pts as (select *, below_a::double / n_a as apcer, (n_b - below_b)::double / n_b as bpcer from cnt)"""


def rates_sql(source: str, thr: str, name: str = "rates", by: str = "") -> str:
    sel = f"{by}, " if by else ""
    return f"""{name} as (select {sel}attack_type, count(*) as n, avg((case when attack_type <> 'bona_fide' then score < {thr} else score >= {thr} end)::int::double) as rate from {source} group by {sel}attack_type)"""


POINT = """max(rate) filter (where attack_type = 'bona_fide') as bpcer, max(rate) filter (where attack_type <> 'bona_fide') as worst_apcer,
avg(rate) filter (where attack_type <> 'bona_fide') as mean_apcer,
sum(n) filter (where attack_type = 'bona_fide')::bigint as n_bona_fide, sum(n) filter (where attack_type <> 'bona_fide')::bigint as n_attack"""
EER = "(select arg_min(struct_pack(r := (apcer + bpcer) / 2, t := value), struct_pack(g := abs(apcer - bpcer), t := value)) from pts)"
AUC = "(select sum(a * (below_b + b / 2)) / (max(n_a)::double * max(n_b)) from pts)"
SC = duck("scored")


def report_sql(source: str, name: str, thr: str = str(THRESHOLD)) -> str:
    """CTEs that end in ``name``: the report row of ``source`` at the threshold, a number or a scalar subquery."""
    c = curve_sql(source)
    for k in ("hist", "cnt", "pts"):
        c = c.replace(f"{k} as (", f"{name}_{k} as (").replace(f"from {k}", f"from {name}_{k}")
    def at(t: float) -> str:
        return f"(select min(bpcer) from {name}_pts where apcer <= {t})"

    return f"""{c}, {rates_sql(source, thr, name + "_rates")},
{name} as (select *, (worst_apcer + bpcer) / 2 as acer, {EER.replace('from pts', f'from {name}_pts')}.r as eer, {EER.replace('from pts', f'from {name}_pts')}.t as eer_threshold,
{AUC.replace('from pts', f'from {name}_pts')} as auc, {at(0.01)} as bpcer_at_0_01, {at(0.05)} as bpcer_at_0_05, {at(0.10)} as bpcer_at_0_10, {thr}::double as threshold
from (select {POINT} from {name}_rates))"""


def _r(*cols: str) -> str:
    return ", ".join(f"round({c}, 9) as {c}" for c in cols)


COND = f"strata as (select 'illumination' as axis, illumination as value, count(*) as n, count(*) filter (where score < {THRESHOLD}) as missed from scored where attack_type <> 'bona_fide' and illumination is not null group by illumination), str as (select *, case when n >= 20 then missed / n end as apcer from strata)"
FAIR = f"fg as (select 'Eyeglasses' as attribute, attr_eyeglasses as value, count(*) as n, count(*) filter (where score >= {THRESHOLD}) as rejected from scored where attack_type = 'bona_fide' group by attr_eyeglasses), fr as (select *, case when n >= 50 then rejected / n end as bpcer from fg), fa as (select attribute, count(bpcer) as rated, max(bpcer) as worst, min(bpcer) as best from fr group by attribute), au as (select *, case when rated >= 2 and best > 0 then worst / best end as ratio, case when rated >= 2 then worst - best end as gap, case when rated >= 2 then coalesce(worst / nullif(best, 0) >= 1.25, false) or (best = 0 and worst > 0) end as flagged from fa)"

SQL = {
    "d1_validate_scores": f"{SC} select count(*) as n_rows, count(*) filter (where score is null) as n_null, count(*) filter (where not isfinite(score)) as n_not_finite, count(*) filter (where score < 0 or score > 1) as n_out_of_range, count(*) filter (where attack_type is null or attack_type not in ('bona_fide', 'print', 'replay', 'cutout', 'mask_3d')) as n_unknown_type from scored",
    "d2_apcer_bpcer": f"{SC}, {rates_sql('scored', str(THRESHOLD))} select attack_type, n, {_r('rate')} from rates",
    "d3_operating_point": f"{SC}, {rates_sql('scored', str(THRESHOLD), by='session')} select session, n_bona_fide, n_attack, {_r('bpcer', 'worst_apcer', 'mean_apcer')}, round((worst_apcer + bpcer) / 2, 9) as acer from (select session, {POINT} from rates group by session)",
    "d4_roc": f"{SC}, {curve_sql('scored')} select value as threshold, {_r('apcer', 'bpcer')} from pts union all select '-inf'::double, 0, 1 union all select 'inf'::double, 1, 0",
    "d5_eer": f"{SC}, {curve_sql('scored')} select round({EER}.r, 9) as eer, round({EER}.t, 9) as eer_threshold",
    "d6_auc": f"{duck('scored_big')}, {curve_sql('scored_big', 'dataset')} select dataset, round(sum(a * (below_b + b / 2)) / (max(n_a)::double * max(n_b)), 9) as auc from pts group by dataset",
    "d7_bpcer_at_apcer": f"{SC}, {curve_sql('scored')}, p2 as (select bpcer, value, apcer, false as clamped from pts union all select 0, max(value), 1, true from pts), t as (select unnest([0.01, 0.05, 0.10, 1.0])::double as target) select target, round(m.bpcer, 9) as bpcer, round(m.t, 9) as threshold, m.clamped as threshold_clamped from (select target, min(struct_pack(bpcer := bpcer, t := value, clamped := clamped)) as m from t join p2 on apcer <= target where not clamped or target >= 1 group by target)",
    "d8_evaluate": f"""{duck('scored_big')}, {curve_sql('scored_big', 'dataset')},
e as (select dataset, arg_min(struct_pack(r := (apcer + bpcer) / 2, t := value), struct_pack(g := abs(apcer - bpcer), t := value)) as m, sum(a * (below_b + b / 2)) / (max(n_a)::double * max(n_b)) as auc,
 min(bpcer) filter (where apcer <= 0.01) as bpcer_at_0_01, min(bpcer) filter (where apcer <= 0.05) as bpcer_at_0_05, min(bpcer) filter (where apcer <= 0.10) as bpcer_at_0_10 from pts group by dataset),
th as (select distinct dataset, unnest([round(m.t, 6), 0.5]) as threshold from e),
rates as (select s.dataset, threshold, attack_type, count(*) as n, avg((case when attack_type <> 'bona_fide' then score < threshold else score >= threshold end)::int::double) as rate from scored_big s join th using (dataset) group by all),
pt as (select dataset, threshold, {POINT} from rates group by dataset, threshold)
select dataset, n_bona_fide, n_attack, round(m.r, 9) as eer, round(m.t, 9) as eer_threshold, {_r('auc', 'bpcer_at_0_01', 'bpcer_at_0_05', 'bpcer_at_0_10', 'threshold', 'bpcer', 'worst_apcer', 'mean_apcer')}, round((worst_apcer + bpcer) / 2, 9) as acer from e join pt using (dataset)""",
    "d9_evaluate_test": f"{SC}, {report_sql('scored', 'rep')} select n_bona_fide, n_attack, case when n_bona_fide + n_attack < 200 then 'small sample' else '' end as note, {_r(*REPORT)} from rep",
    "d9_evaluate_slices": f"""{SC}, sl as (select attack_type, score, sum(n) as n, concat_ws(',', case when grouping(session) = 0 then 'session=' || session end, case when grouping(attr_eyeglasses) = 0 then 'attr_eyeglasses=' || attr_eyeglasses end) as key
from (select session, attr_eyeglasses, attack_type, score, count(*) as n from scored group by all) group by grouping sets ((attack_type, score), (session, attack_type, score), (attr_eyeglasses, attack_type, score), (session, attr_eyeglasses, attack_type, score))),
sr as (select case when key = '' then 'all' else key end as slice, attack_type, score from sl, range(cast(n as bigint))),
{curve_sql('sr', 'slice')}, {rates_sql('sr', str(THRESHOLD), by='slice')}, op as (select slice, {POINT} from rates group by slice),
fg as (select slice, min(struct_pack(g := abs(apcer - bpcer), t := value, r := (apcer + bpcer) / 2)) as m, sum(a * (below_b + b / 2)) / (max(n_a)::double * max(n_b)) as auc, min(bpcer) filter (where apcer <= 0.01) as bpcer_at_0_01, min(bpcer) filter (where apcer <= 0.05) as bpcer_at_0_05, min(bpcer) filter (where apcer <= 0.10) as bpcer_at_0_10 from pts group by slice)
select slice, n_bona_fide, n_attack, {_r('bpcer', 'worst_apcer', 'mean_apcer')}, round((worst_apcer + bpcer) / 2, 9) as acer, round(m.r, 9) as eer, round(m.t, 9) as eer_threshold, {_r('auc', 'bpcer_at_0_01', 'bpcer_at_0_05', 'bpcer_at_0_10')}, {THRESHOLD}::double as threshold from op join fg using (slice)""",
    "d10_stratify": f"{SC}, {COND} select axis, value, n, missed, {_r('apcer')} from str",
    "d11_fairness_groups": f"{SC}, {FAIR} select attribute, value, n, rejected, {_r('bpcer')} from fr",
    "d11_fairness_audit": f"{SC}, {FAIR} select attribute, rated, {_r('worst', 'best', 'ratio', 'gap')}, flagged from au",
    "f1_report_types": f"{SC}, {rates_sql('scored', str(THRESHOLD))}, atk as (select * from rates where attack_type <> 'bona_fide') select row_number() over (order by rate desc, attack_type) as pos, attack_type, n, round(rate, 9) as apcer, (select max(rate) > min(rate) from atk) and rate = (select max(rate) from atk) as weakest from atk",
    "f1_report_conditions": f"{SC}, {COND} select row_number() over (partition by axis order by apcer is null, apcer desc, value) as pos, axis, value, n, {_r('apcer')} from str",
    "f1_report_fairness": f"{SC}, {FAIR} select row_number() over (order by coalesce(flagged, false) desc, coalesce(ratio, 0) desc, attribute) as pos, attribute, {_r('ratio')}, coalesce(flagged, false) as flagged, case when not coalesce(flagged, false) then '' when ratio is null then 'best group without errors' else printf('worst group %.2f times the best', ratio) end as note, attribute = 'Pale_Skin' as caveat from au",
    "f2_markdown_rows": f"""{SC}, {report_sql('scored', 'rep')}
select 1::bigint as pos, 'EER' as metric, printf('%.2f', round(eer * 100, 2)) || '%' as value from rep union all select 2, 'AUC', printf('%.4f', round(auc, 4)) from rep union all select 3, 'BPCER @ deployed threshold', printf('%.2f', round(bpcer * 100, 2)) || '%' from rep
union all select 4, 'APCER (worst case)', printf('%.2f', round(worst_apcer * 100, 2)) || '%' from rep union all select 5, 'ACER', printf('%.2f', round(acer * 100, 2)) || '%' from rep
union all select 5 + row_number() over (order by attack_type), 'APCER of ' || attack_type, printf('%.2f', round(rate * 100, 2)) || '%' from rep_rates where attack_type <> 'bona_fide'
union all select 100, 'Test samples', n_bona_fide::varchar || ' bona fide / ' || n_attack::varchar || ' attack' from rep""",
    "c4_verify_scores": f"{duck('score_pair')}, t as (select unnest([1e-4, 0.05])::double as tolerance) select tolerance, count(*) as n, count(*) filter (where expected is null or actual is null) as missing, round(max(abs(expected - actual)), 9) as max_abs_diff, max(abs(expected - actual)) <= tolerance as passed from score_pair, t group by tolerance",
    "c5_join_scores": f"{SC} select sample_id, subject, attack_type, score from scored",
    "c9_cross_dataset": f"""{SC}, s0 as (select * from scored where sample_id % 2 = 0), s1 as (select * from scored where sample_id % 2 = 1), {report_sql('s0', 'src')}, {report_sql('s1', 'tgt')},
l as (select m.metric, m.source, m.target, m.target - m.source as delta from (select unnest([{', '.join(f"struct_pack(metric := '{m}', source := src.{m}, target := tgt.{m})" for m in E.COMPARED)}]) as m from src, tgt)),
g as (select max(delta) filter (where metric = 'eer') as e, greatest(max(delta) filter (where metric = 'worst_apcer'), max(delta) filter (where metric = 'bpcer')) as o from l)
select metric, {_r('source', 'target', 'delta')}, case when abs(delta) < 1e-9 then '=' when (delta > 0) = (metric = 'auc') then 'better' else 'worse' end as direction,
case when e > 0.10 then 'discrimination_collapse' when o > 0.10 then 'threshold_did_not_transfer' when e > 0.03 or o > 0.03 then 'moderate' else 'small' end as verdict from l, g""",
}
QUERIES = {k: v for k, v in list(globals().items()) if k in SQL}
