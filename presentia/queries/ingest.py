"""Queries of ingest, quarantine and split operators over ``orders``, ``customer`` and ``events``."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presentia.functions import annotation as A
from presentia.operators import quality as Q
from presentia.operators import splits as S
from presentia.plans.materialize import scratch_path
from presentia.queries.adapters import adapted, duck
from presentia.sources import annotations as src

NUMBER = "cast(regexp_extract(path, '([0-9]+)', 1) as bigint)"
LISTED = "cast(regexp_extract(path, '([0-9]+)[.]png$', 1) as bigint) % 20 <> 7"


def _annotations(spark: SparkSession, sf: str) -> DataFrame:
    return adapted(spark, sf, "annotations")


def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    return adapted(spark, sf, "manifest")


def _split(spark: SparkSession, sf: str, by: str = "subject") -> DataFrame:
    return S.group_split(_manifest(spark, sf), seed=7, by=by)


def a1_read_annotations(spark, sf):
    path = scratch_path(spark, "annotations")
    _annotations(spark, sf).write.json(path)
    return src.read_annotations(spark, path, lines=True).select("path", F.size("vec").alias("n"), F.array_join(F.transform("vec", lambda x: x.cast("string")), ",").alias("vec"))


def _one_object(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries that end in a comma as the lines of one object, in the order they come; the last loses its comma. Holds one batch."""
    held = None

    def lines(*texts: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["value"])

    yield lines("{")
    for b in batches:
        if b.num_rows:
            if held is not None:
                yield held
            held = b
    if held is not None:
        yield held.slice(0, held.num_rows - 1)
        yield lines(held.column("value")[held.num_rows - 1].as_py()[:-1])
    yield lines("}")


def a1_read_annotation_object(spark, sf):
    """The same as one JSON object in one file, read by byte ranges."""
    path = scratch_path(spark, "annotations")
    entry = F.concat(F.to_json(F.struct("path")), F.lit(":"), F.to_json("vec"))
    # {"path":"a"}:[1] becomes "a":[1],
    rows = _annotations(spark, sf).select(F.regexp_replace(entry, r'^\{"path":(.*)\}:\[(.*)$', "$1:[$2,").alias("value"))
    rows.repartition(1).mapInArrow(_one_object, "value string").write.text(path)
    out = src.read_annotations(spark, path)
    return out.select("path", F.size("vec").alias("n"), F.array_join(F.transform("vec", lambda x: x.cast("string")), ",").alias("vec"))


def a2_read_manifest(spark, sf):
    path = scratch_path(spark, "manifest")
    # One sample in three has no session: the reader fills it in.
    m = _manifest(spark, sf).withColumn("session", F.when(F.expr(f"{NUMBER} % 3 > 0"), F.col("session")))
    src.write_manifest(m, path)
    return src.read_manifest(spark, path).select("path", "attack_type", "subject", "session", "instrument", F.size("conditions").alias("n_conditions"))


def a3_write_manifest(spark, sf):
    path = scratch_path(spark, "manifest")
    src.write_manifest(_manifest(spark, sf), path)
    return spark.read.schema(src.SAMPLE).json(path).select("path", "attack_type", "subject", "session", "instrument")


def a4_append_manifest(spark, sf):
    m = _manifest(spark, sf)
    return src.append_manifest(m.filter("session = 'd0'"), m.filter("session <> 'd0'").drop("instrument"))


def a5_resolve_image_root(spark, sf):
    m = _manifest(spark, sf).select("path")
    there = src.resolve_image_root(m, sf, "/mnt/images").select("path", (F.col("image") == F.concat(F.lit(sf.rstrip("/") + "/"), "path")).alias("below_root"))
    gone = src.resolve_image_root(m, f"{sf}/no-such-folder", "/mnt/images/").select("path", F.col("image").alias("fallback"))
    return there.join(gone, "path")


def a6_missing_files(spark, sf):
    return src.missing_files(_manifest(spark, sf), adapted(spark, sf, "listing")).select("path", "subject")


def a7_verify_checksums(spark, sf):
    path = scratch_path(spark, "artifacts")
    parts = adapted(spark, sf, "listing").withColumn("k", F.floor(F.expr(f"{NUMBER}") / 1000))  # files grow in number, not in size
    parts.repartition("k").sortWithinPartitions("k", "path").write.partitionBy("k").text(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter(F.endswith("path", F.lit(".txt"))).select(F.regexp_extract("path", "k=([0-9]+)", 1).alias("name"), "path")
    # What is expected: the right digest, for one name in five a wrong one, for one in five none; one name has no file.
    text = parts.groupBy(F.col("k").cast("string").alias("name")).agg(F.array_join(F.array_sort(F.collect_list("path")), "\n").alias("t"))
    k = F.col("name").cast("int") % 5
    expected = text.select("name", F.when(k == 1, F.lit("0" * 64)).when(k != 2, F.sha2(F.concat("t", F.lit("\n")).cast("binary"), 256)).alias("sha256"))
    gone = text.agg(F.lit("gone").alias("name"), F.sha2(F.max("t").cast("binary"), 256).alias("sha256"))
    return src.verify_checksums(src.file_digests(files), expected.unionByName(gone))


def a8_read_run_summary(spark, sf):
    path = scratch_path(spark, "summaries")
    runs = adapted(spark, sf, "history").groupBy("run_id").agg(F.min("val_eer").alias("threshold"))
    good = F.to_json(F.struct("run_id", F.when(F.col("run_id") % 10 != 4, F.col("threshold")).alias("threshold"), F.lit("subject").alias("split_by")))
    runs.select(F.when(F.col("run_id") % 10 == 3, F.concat(F.lit("{broken "), F.col("run_id").cast("string"))).otherwise(good).alias("value")).write.text(path)
    return src.read_run_summary(spark, path)


def a10_write_report(spark, sf):
    path = scratch_path(spark, "report")
    report = Q.manifest_stats(_manifest(spark, sf))
    src.write_report(report, path)
    return spark.read.schema(report.schema).json(path)


def b1_subject_from_path(spark, sf):
    return _annotations(spark, sf).select("path", A.subject_from_path(F.col("path")).alias("subject"))


def b2_decode_attack_type(spark, sf):
    return _annotations(spark, sf).select("path", A.attack_type(F.col("vec")).alias("attack_type"), A.spoof_name(F.col("vec")).alias("spoof_name"))


def b3_label_errors(spark, sf):
    return _annotations(spark, sf).select("path", A.label_error(F.col("vec")).alias("label_error"))


def b4_decode_conditions(spark, sf):
    c = A.conditions(F.col("vec"))
    return _annotations(spark, sf).filter(A.label_error(F.col("vec")).isNull()).select("path", *[F.element_at(c, k).alias(k) for k in ("spoof_type", "illumination", "environment")], F.size(c).alias("n"))


def b5_decode_attributes(spark, sf):
    a = A.attributes(F.col("vec"))
    return _annotations(spark, sf).filter(A.label_error(F.col("vec")).isNull()).select("path", *[F.element_at(a, f"attr:{k}").alias(k.lower()) for k in A.AUDITED])


def b6_is_attack(spark, sf):
    return _manifest(spark, sf).select("path", (F.col("attack_type") != "bona_fide").alias("is_attack"), A.label(F.col("attack_type")).alias("label"))


def b7_group_key(spark, sf):
    return _manifest(spark, sf).select("path", A.group_key("subject").alias("by_subject"), A.group_key("session").alias("by_session"))


def _reasoned(spark, sf):
    a = _annotations(spark, sf)
    return Q.reasons(Q.decode(a), a.select("path").filter(LISTED))


def k1_quarantine(spark, sf):
    return Q.quarantine(_reasoned(spark, sf))[1]


def k2_require(spark, sf):
    return Q.require(_manifest(spark, sf), F.col("attack_type").isin(*set(A.SPOOF_ATTACKS.values())), "unknown attack type").select("path", "attack_type")


def e1_limit_whole_subjects(spark, sf):
    good = Q.quarantine(_reasoned(spark, sf))[0]
    return Q.limit_whole_subjects(good, 1000).select("path", "subject")


def d12_class_weights(spark, sf):
    return Q.class_weights(_manifest(spark, sf)).select("label", "n", F.round("weight", 9).alias("weight"))


def d13_manifest_stats(spark, sf):
    return Q.manifest_stats(_manifest(spark, sf))


def e2_group_split(spark, sf):
    return _split(spark, sf).select("path", "subject", "split")


def e2_group_split_sessions(spark, sf):
    return _split(spark, sf, "session").select("path", "group_key", "split")


def _leaky(spark, sf):
    """A split with a fault in every tenth group, and no val rows of class 1."""
    split = _split(spark, sf)
    moved = F.when((F.substring("group_key", 2, 9).cast("int") % 10 == 0) & (F.col("session") == "d1"), "test").otherwise(F.col("split"))
    return split.withColumn("split", moved).filter("split <> 'val' or attack_type = 'bona_fide'")


def d14_split_integrity(spark, sf):
    return S.split_integrity(_leaky(spark, sf))


def d14_subject_overlap(spark, sf):
    return S.subject_overlap(_split(spark, sf, "session"))


def d15_fingerprint(spark, sf):
    return S.fingerprint(_split(spark, sf), "subject")


def c6_verify_split(spark, sf):
    split = _split(spark, sf)
    recorded = S.fingerprint(split, "subject")
    same = S.verify_split(recorded, split.filter("split = 'test'"), "subject")
    other = S.verify_split(recorded, S.group_split(_manifest(spark, sf), seed=8).filter("split = 'test'"), "subject")
    none = S.verify_split(recorded.filter("split <> 'test'"), split.filter("split = 'test'"), "subject")
    return same.withColumn("case", F.lit("same")).unionByName(other.withColumn("case", F.lit("other"))).unionByName(none.withColumn("case", F.lit("none"))).select(
        "case", "status", "missing", "unexpected", "trained_on", F.array_join("examples", ",").alias("examples")
    )


def c7_shared_subjects(spark, sf):
    m = _manifest(spark, sf)
    return S.shared_subjects(m.filter("session = 'd0' and attack_type = 'print'"), m.filter("session = 'd1' and attack_type = 'replay'"))


def f3_top_offenders(spark, sf):
    from presentia.operators.reports import top_offenders

    return top_offenders(src.missing_files(_manifest(spark, sf), adapted(spark, sf, "listing")), "path")


def j1_import_annotations(spark, sf):
    path = scratch_path(spark, "imported")
    a = _annotations(spark, sf)
    Q.import_annotations(a, path, a.select("path").filter(LISTED))
    return src.read_manifest(spark, path).select("path", "subject", "attack_type", "session", F.size("conditions").alias("n_conditions"))


def j7_manifest_check(spark, sf):
    m = _manifest(spark, sf)
    stats = Q.manifest_stats(m).select(F.coalesce("attack_type", F.lit("all")).alias("item"), F.col("n").alias("value"))
    missing = src.missing_files(m, adapted(spark, sf, "listing")).agg(F.lit("missing files").alias("item"), F.count(F.lit(1)).alias("value"))
    split = S.group_split(m, seed=7)
    sizes = split.groupBy(F.concat(F.lit("split "), "split").alias("item")).agg(F.count(F.lit(1)).alias("value"))
    faults = S.split_integrity(split).agg(F.lit("split faults").alias("item"), F.count(F.lit(1)).alias("value"))
    return stats.unionByName(missing).unionByName(sizes).unionByName(faults)


def _case(codes: dict[int, str], key: str) -> str:
    return "case " + " ".join(f"when {key} = {k} then '{v}'" for k, v in codes.items()) + " end"


AN, MA = duck("annotations"), duck("manifest")
SUBJECT = "coalesce(string_split(path, '/')[list_filter(range(2, len(string_split(path, '/')) + 1), lambda i: string_split(path, '/')[i] in ('live', 'spoof') and regexp_full_match(string_split(path, '/')[i - 1], '[0-9]+'))[1] - 1], list_filter(string_split(path, '/')[:-2], lambda p: regexp_full_match(p, '[0-9]+'))[1])"
KIND, NAME = _case(A.SPOOF_ATTACKS, "vec[41]"), _case(A.SPOOF_NAMES, "vec[41]")
ERROR = f"case when len(vec) < 44 then 'short_vector' when ({KIND}) is null then 'unknown_code' when (vec[44] <> 0) <> (({KIND}) <> 'bona_fide') then 'flag_disagrees' end"
DEC = f"dec as (select path, vec, {SUBJECT} as subject, {KIND} as attack_type, {ERROR} as label_error from annotations)"
ILL, ENV = _case(A.ILLUMINATIONS, "vec[42]"), _case(A.ENVIRONMENTS, "vec[43]")
LISTED_DUCK = LISTED.replace("[.]", "[.]")
REASON = f"rs as (select *, case when subject is null then 'bad_path' when not ({LISTED_DUCK}) then 'missing_file' else label_error end as reason from dec)"


def _limit_sql(limit: int) -> str:
    return f"good as (select * from rs where reason is null), sc as (select subject, count(*) as n from good group by subject), sl as (select subject, coalesce(sum(n) over (order by cast(subject as bigint), subject rows between unbounded preceding and 1 preceding), 0) as before from sc), lim as (select * from good where subject in (select subject from sl where before < {limit}))"


def _split_sql(name: str = "spl", seed: int = 7, key: str = "subject") -> str:
    return f"""{name}_g as (select distinct {key} as group_key from manifest), {name}_o as (select group_key, row_number() over (order by md5('{seed}:' || group_key), group_key) - 1 as pos, count(*) over () as n from {name}_g),
{name}_k as (select *, greatest(1, cast(round_even(n * 0.2::double, 0) as bigint)) as m from {name}_o),
{name} as (select manifest.*, group_key, case when pos < m then 'test' when pos < 2 * m then 'val' else 'train' end as split from manifest join {name}_k on group_key = {key})"""


N_COND = f"(case when vec[44] <> 0 then 1 + (({ILL}) is not null)::int + (({ENV}) is not null)::int else 0 end)"
SQL = {
    "a1_read_annotations": f"{AN} select path, len(vec)::int as n, array_to_string(vec, ',') as vec from annotations",
    "a1_read_annotation_object": f"{AN} select path, len(vec)::int as n, array_to_string(vec, ',') as vec from annotations",
    "a2_read_manifest": f"{MA} select path, attack_type, subject, case when {NUMBER} % 3 > 0 then session else 'default' end as session, instrument, 0::int as n_conditions from manifest",
    "a7_verify_checksums": f"{duck('listing')} select distinct cast({NUMBER} // 1000 as varchar) as name, case {NUMBER} // 1000 % 5 when 1 then 'differs' when 2 then 'unchecked' else 'ok' end as status from listing union all select 'gone', 'missing'",
    "d14_split_integrity": f"{MA}, {_split_sql()}, lk as (select *, case when cast(substr(group_key, 2) as int) % 10 = 0 and session = 'd1' then 'test' else split end as s2 from spl), l2 as (select * from lk where s2 <> 'val' or attack_type = 'bona_fide') select 'leaked_group' as kind, group_key as detail from l2 group by group_key having count(distinct s2) > 1 union all select 'single_class', s2 from l2 group by s2 having count(distinct (attack_type <> 'bona_fide')::int) < 2",
    "a3_write_manifest": f"{MA} select path, attack_type, subject, session, instrument from manifest",
    "a5_resolve_image_root": f"{MA} select path, true as below_root, concat('/mnt/images/', path) as fallback from manifest",
    "a10_write_report": f"{MA} select attack_type, count(*) as n, count(distinct subject) as subjects, count(distinct subject || '/' || session) as sessions, count(distinct instrument) as instruments from manifest group by rollup (attack_type)",
    "a4_append_manifest": f"{MA} select path, attack_type, subject, session, case when session = 'd0' then instrument end as instrument from manifest",
    "a6_missing_files": f"{duck('manifest', 'listing')} select path, subject from manifest anti join listing using (path)",
    "a8_read_run_summary": f"{duck('history')}, r as (select run_id, min(val_eer) as threshold from history group by run_id) select case when run_id % 10 <> 3 then run_id end as run_id, case when run_id % 10 not in (3, 4) then threshold end as threshold, case when run_id % 10 not in (3, 4) then 'subject' end as split_by, run_id % 10 not in (3, 4) as verifiable from r",
    "b1_subject_from_path": f"{AN} select path, {SUBJECT} as subject from annotations",
    "b2_decode_attack_type": f"{AN} select path, {KIND} as attack_type, {NAME} as spoof_name from annotations",
    "b3_label_errors": f"{AN} select path, {ERROR} as label_error from annotations",
    "b4_decode_conditions": f"{AN}, {DEC} select path, case when vec[44] <> 0 then {NAME} end as spoof_type, case when vec[44] <> 0 then {ILL} end as illumination, case when vec[44] <> 0 then {ENV} end as environment, {N_COND} as n from dec where label_error is null",
    "b5_decode_attributes": f"{AN}, {DEC} select path, " + ", ".join(f"case when vec[{at + 1}] > 0 then 'yes' else 'no' end as {k.lower()}" for k, at in A.AUDITED.items()) + " from dec where label_error is null",
    "b6_is_attack": f"{MA} select path, attack_type <> 'bona_fide' as is_attack, (attack_type <> 'bona_fide')::int as label from manifest",
    "b7_group_key": f"{MA} select path, subject as by_subject, subject || '/' || session as by_session from manifest",
    "k1_quarantine": f"{AN}, {DEC}, {REASON} select reason, count(*) as n from rs where reason is not null group by reason",
    "k2_require": f"{MA} select path, attack_type from manifest",
    "e1_limit_whole_subjects": f"{AN}, {DEC}, {REASON}, {_limit_sql(1000)} select path, subject from lim",
    "d12_class_weights": f"{MA}, c as (select (attack_type <> 'bona_fide')::int as label, count(*) as n from manifest group by 1) select label, n, round((select sum(n) from c) / (2 * n), 9) as weight from c",
    "d13_manifest_stats": f"{MA} select attack_type, count(*) as n, count(distinct subject) as subjects, count(distinct subject || '/' || session) as sessions, count(distinct instrument) as instruments from manifest group by rollup (attack_type)",
    "e2_group_split": f"{MA}, {_split_sql()} select path, subject, split from spl",
    "e2_group_split_sessions": f"{MA}, {_split_sql(key="subject || '/' || session")} select path, group_key, split from spl",
    "d14_subject_overlap": f"{MA}, {_split_sql(key="subject || '/' || session")}, p as (select subject, count(distinct split) as k from spl group by subject) select count(*) as subjects, count(*) filter (where k > 1) as shared from p",
    "d15_fingerprint": f"{MA}, {_split_sql()} select distinct 'subject' as split_by, split, group_key from spl",
    "c6_verify_split": f"""{MA}, {_split_sql()}, {_split_sql('oth', 8)}, rec as (select distinct split, group_key from spl), ot as (select distinct group_key from oth where split = 'test'),
tr as (select group_key from ot where group_key in (select group_key from rec where split = 'train'))
select 'same' as case, 'verified' as status, 0 as missing, 0 as unexpected, 0 as trained_on, '' as examples
union all select 'other', 'differs', (select count(*) from rec where split = 'test' and group_key not in (select group_key from ot)), (select count(*) from ot where group_key not in (select group_key from rec where split = 'test')), (select count(*) from tr), (select string_agg(group_key, ',' order by group_key) from (select group_key from tr order by group_key limit 5))
union all select 'none', 'not_verified', 0, (select count(*) from rec where split = 'test'), 0, ''""",
    "c7_shared_subjects": f"{MA} select subject from manifest where session = 'd0' and attack_type = 'print' intersect select subject from manifest where session = 'd1' and attack_type = 'replay'",
    "f3_top_offenders": f"{duck('manifest', 'listing')} select path from manifest anti join listing using (path) order by path limit 5",
    "j1_import_annotations": f"{AN}, {DEC}, {REASON} select path, subject, attack_type, 'default' as session, 10 + {N_COND} as n_conditions from rs where reason is null",
    "j7_manifest_check": f"{duck('manifest', 'listing')}, {_split_sql()} select coalesce(attack_type, 'all') as item, count(*) as value from manifest group by rollup (attack_type) union all select 'missing files', count(*) from manifest anti join listing using (path) union all select 'split ' || split, count(*) from spl group by split union all select 'split faults', 0",
}
QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and k[:1] in "abcdefjk" and k[1:2].isdigit()}
