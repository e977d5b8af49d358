"""Adapters: the driver's tables in the shapes of the operators' inputs.

Each text runs in Spark SQL with the tables as arguments and, where no second text is given, in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

SQL = {
    "scored": """
select event_id as sample_id, concat('s', cast(user_id % 97 as string)) as subject,
       concat('d', cast(event_id % 3 as string)) as session, attack_type,
       floor(10000 * v / (v + 60)) / 10000 as score,
       case when attack_type = 'bona_fide' then null
            when user_id % 4 = 0 then 'back' when user_id % 4 = 1 then 'normal'
            when user_id % 4 = 2 then 'strong' else 'dark' end as illumination,
       case when user_id % 3 = 0 then 'yes' else 'no' end as attr_eyeglasses
from (select *, case when attack_type = 'bona_fide' then value else value + 25 end as v
      from (select *, case event_type when 'view' then 'bona_fide' when 'click' then 'print'
                        when 'purchase' then 'replay' when 'error' then 'cutout' else 'mask_3d' end as attack_type
            from events) e1) e2
""",
    "scored_big": """
select attack_type, l_linestatus as dataset, floor(1000 * q / (q + 25)) / 1000 as score
from (select l_linestatus, case l_returnflag when 'N' then 'bona_fide' when 'A' then 'print' else 'replay' end as attack_type,
             case when l_returnflag = 'N' then l_quantity else l_quantity + 15 end as q from lineitem) l
""",
    "manifest": """
select concat('img/', cast(o_orderkey as string), '.png') as path,
       case o_orderkey % 4 when 0 then 'bona_fide' when 1 then 'print' when 2 then 'replay' else 'cutout' end as attack_type,
       concat('c', cast(o_custkey % 200 as string)) as subject,
       concat('d', cast(o_orderkey % 3 as string)) as session,
       case when o_orderkey % 4 = 0 then null else concat('dev', cast(o_orderkey % 5 as string)) end as instrument
from orders
""",
    "listing": """
select concat('img/', cast(o_orderkey as string), '.png') as path from orders where o_orderkey % 20 <> 7
""",
    "annotations": """
select case when o_orderkey % 50 = 3 then concat('x/', cast(o_orderkey as string), '.png')
            else concat('Data/2020/train/', cast(o_custkey as string), case when o_orderkey % 11 = 0 then '/live/' else '/spoof/' end,
                        cast(o_orderkey as string), '.png') end as path,
       transform(sequence(0, case when o_orderkey % 100 = 13 then 39 else 43 end), i ->
         case when i < 40 then case when (o_orderkey + i) % 3 = 0 then 1 else -1 end
              when i = 40 then case when o_orderkey % 100 = 29 then 11 else o_orderkey % 11 end
              when i = 41 then case when o_orderkey % 11 = 0 then 0 else o_orderkey % 4 + 1 end
              when i = 42 then case when o_orderkey % 11 = 0 then 0 else o_orderkey % 2 + 1 end
              else case when (o_orderkey % 11 = 0) = (o_orderkey % 100 = 7) then 1 else 0 end end) as vec
from orders
""",
    "gallery": """
select concat('p', cast(label as string)) as name, vec_id as ordinal, embedding as v from embeddings where vec_id % 2 = 0
""",
    "probes": """
select vec_id as probe_id, case when vec_id % 2 = 1 then transform(embedding, x -> cast(x as double))
       else transform(embedding, (x, i) -> cast(x as double) + 0.001 * (i % 3)) end as v from embeddings
""",
    "detections": """
select l_orderkey as image_id, l_linenumber as cand_id, x1, y1, x1 + w as x2, y1 + w as y2, s as score
from (select l_orderkey, l_linenumber, cast(min(l_partkey) % 60 as int) as x1, cast(min(l_suppkey) % 60 as int) as y1,
             cast(60 + max(l_quantity) as int) as w, max(l_discount) * 10 as s
      from lineitem group by l_orderkey, l_linenumber) d
""",
    "faces": """
select event_id as face_id, user_id % 4 as camera, ts,
       event_id as frame_id,
       cast(event_id * 37 % 600 as int) as x1, cast(event_id * 53 % 400 as int) as y1,
       cast(event_id * 37 % 600 + 60 + event_id % 120 as int) as x2, cast(event_id * 53 % 400 + 60 + event_id % 120 as int) as y2,
       case when event_type = 'signup' then null else floor(10000 * value / (value + 60)) / 10000 end as spoof_probability,
       event_id % 500 as vec_id, cast(event_id % 90 as double) as sharpness,
       value / 10 as detect_ms, value / 100 as liveness_ms, value / 50 as recognize_ms
from events
""",
    "latency": """
select event_type as stage, case when user_id % 2 = 0 then 1 else 16 end as batch,
       event_id as run, value as ms from events
""",
    "history": """
select run_id, epoch, val_eer, val_loss
from (select o_custkey as run_id, row_number() over (partition by o_custkey order by o_orderkey) - 1 as epoch,
             cast(o_orderkey * 37 % 50 as double) / 100 as val_eer, o_totalprice / 100000 as val_loss from orders) h
""",
    "gallery_all": """
select concat('p', cast(label as string)) as name, vec_id as ordinal, embedding as v from embeddings
""",
    "score_pair": """
select event_id as sample_id, value / 500 as expected, value / 500 + 0.00005 * (event_id % 3) as actual from events
""",
}

# Where the two dialects differ.
DUCKDB = {
    "annotations": """
select case when o_orderkey % 50 = 3 then concat('x/', cast(o_orderkey as string), '.png')
            else concat('Data/2020/train/', cast(o_custkey as string), case when o_orderkey % 11 = 0 then '/live/' else '/spoof/' end,
                        cast(o_orderkey as string), '.png') end as path,
       list_transform(range(0, case when o_orderkey % 100 = 13 then 40 else 44 end), lambda i:
         case when i < 40 then case when (o_orderkey + i) % 3 = 0 then 1 else -1 end
              when i = 40 then case when o_orderkey % 100 = 29 then 11 else o_orderkey % 11 end
              when i = 41 then case when o_orderkey % 11 = 0 then 0 else o_orderkey % 4 + 1 end
              when i = 42 then case when o_orderkey % 11 = 0 then 0 else o_orderkey % 2 + 1 end
              else case when (o_orderkey % 11 = 0) = (o_orderkey % 100 = 7) then 1 else 0 end end) as vec
from orders
""",
    "probes": """
select vec_id as probe_id, case when vec_id % 2 = 1 then list_transform(embedding, lambda x: cast(x as double))
       else list_transform(embedding, lambda x, i: cast(x as double) + 0.001 * ((i - 1) % 3)) end as v from embeddings
""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def adapted(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The adapter ``name`` over the tables of ``sf_dir``."""
    text = SQL[name]
    used = [t for t in TABLES if re.search(rf"\b(from|join) {t}\b", text)]
    for t in used:
        text = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def duck(*names: str) -> str:
    """``with`` clause that defines the adapters for DuckDB."""
    return "with " + ",\n".join(f"{n} as ({DUCKDB.get(n, SQL[n]).strip()})" for n in names)
