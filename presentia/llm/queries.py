"""The registered queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presentia.llm import toxicity
from presentia.llm.hard_negatives import hard_negatives
from presentia.llm.html_extract import html_extract
from presentia.llm.imatch import imatch
from presentia.llm.license_scan import license_scan
from presentia.llm.minhash import near_duplicates
from presentia.llm.mixing import mix, mix_sql
from presentia.llm.substring_dedup import substring_dedup
from presentia.llm.spelling import spelling_groups
from presentia.llm.token_files import token_round_trip
from presentia.llm.warc import warc_round_trip
from presentia.llm.bpe import bpe_round_trip
from presentia.llm.exact_dedup import exact_dedup


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies by block naming over whole ``documents``."""
    return exact_dedup(_documents(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of whole ``documents`` that repeat a 13-word window of a smaller doc_id are removed."""
    return substring_dedup(_documents(spark, sf_dir))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WARC records of every row of ``pages``, written to seekable bundles and read back."""
    return warc_round_trip(spark, _pages(spark, sf_dir)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and template matches in every whole text of ``documents``."""
    return license_scan(_documents(spark, sf_dir))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``."""
    return html_extract(_pages(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token weights of all ``documents`` raked to source, language and topic targets, and the sample drawn."""
    return mix(_documents(spark, sf_dir))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of whole ``documents``: four-word shingles, similarity 0.8."""
    return near_duplicates(_documents(spark, sf_dir), size=4, percent=80)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every whole text of ``documents``; the model never sees fold 0 of ``labels``."""
    docs = _documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding and decoding of every whole text of ``documents``."""
    return bpe_round_trip(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of every whole text of ``documents`` and of its edited text."""
    return imatch(_documents(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth row of ``embeddings``, mined among all rows."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(rows, F.col("vec_id") % 100 == 0, moved, scale=256)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of whole ``documents``; some runs lose a character first."""
    return spelling_groups(_documents(spark, sf_dir), damage=97)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed token ids of every whole text of ``documents``, written to files and read back."""
    return token_round_trip(spark, _documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


OP1_SQL = """
with n as (
  select doc_id, length(coalesce(text, '')) as n_cp,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') as t
  from documents)
select doc_id,
       first_value(doc_id) over (partition by t order by n_cp desc, doc_id) as keep_id,
       count(*) over (partition by t) as group_size,
       row_number() over (partition by t order by n_cp desc, doc_id) = 1 as kept,
       sha256(t) as text_sha256
from n
"""


OP2_SQL = """
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
win as (select doc_id, i, array_to_string(ws[i:i + 12], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w where len(ws) >= 13)),
f as (select k, min(doc_id) as m from win group by k),
cov as (select distinct doc_id, i + o as p from win join f using (k), range(13) t(o) where m < doc_id),
words as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from w),
kept as (select doc_id, string_agg(word, ' ' order by p) as t, count(*) as n from words anti join cov using (doc_id, p) group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from w left join kept using (doc_id)
"""


OP3_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html)) as payload_bytes, sha256(html) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest, payload_bytes) as first_id from d)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and first_id <> page_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and first_id <> page_id then first_id end as refers_to
from f
"""


OP11_SQL = """
with r as (
  select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.id as anchor_id, b.id as id, a.label = b.label as same, cast(list_inner_product(a.q, b.q) as bigint) as score
  from r a join r b on a.id % 100 = 0 and a.id <> b.id),
p as (
  select anchor_id, id as positive_id, score as positive_score
  from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, id) as integer) as rank,
       id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id)
where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, id) <= 5
"""


OP12_SQL = """
with recursive
bits as (select b, b as c, 0 as k from range(256) t(b) union all select b, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
crc as (select list(c order by b) as t from bits where k = 8),
found as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) as run from documents),
runs as (select doc_id, run, count(*) as n, hex(encode(concat(doc_id, ':', run))) as bytes from found group by all),
hashed as (
  select run, n, xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(range(cast(length(bytes) / 2 as bigint)), lambda i: cast('0x' || substr(bytes, 2 * i + 1, 2) as bigint))),
                     lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) as h
  from runs, crc),
result as (select case when h % 97 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from hashed),
words as (select word, cast(sum(n) as bigint) as n from result where length(word) >= 5 group by word having sum(n) >= 3),
places as (select word, n, unnest(range(1, length(word) + 1)) as j from words),
less as (select word, n, j, substr(word, 1, j - 1) || substr(word, j + 1) as rest from places),
pairs as (
  select a.word, b.word as near, b.n as near_n from less a join less b using (j, rest) where a.word <> b.word
  union select a.word, b.word, b.n from less a join words b on a.rest = b.word
  union select b.word, a.word, a.n from less a join words b on a.rest = b.word),
best as (select word, cast(count(*) as bigint) as n_near, first(near order by near_n desc, near) as near, max(near_n) as near_n from pairs group by word),
named as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when near_n >= 2 * w.n then near end as form, case when near_n >= 2 * w.n then near_n end as form_n
  from words w left join best using (word)),
chain as (select word, word as at, form as next from named union all select c.word, c.next, m.form from chain c join named m on m.word = c.next)
select m.word, m.form, c.at as root, m.n, m.n_near, m.form_n from named m join chain c on c.word = m.word and c.next is null
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_exact_dedup": op1_exact_dedup, "op2_substring_dedup": op2_substring_dedup, "op3_warc": op3_warc, "op4_license_scan": op4_license_scan, "op5_html_extraction": op5_html_extraction, "op6_mixing": op6_mixing, "op7_minhash_near_dedup": op7_minhash_near_dedup, "op8_toxicity": op8_toxicity, "op9_byte_level_bpe": op9_byte_level_bpe, "op10_document_fingerprints": op10_document_fingerprints, "op11_hard_negatives": op11_hard_negatives, "op12_spelling_variants": op12_spelling_variants, "op13_token_files": op13_token_files}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op2_substring_dedup": OP2_SQL, "op3_warc": OP3_SQL, "op6_mixing": mix_sql(), "op11_hard_negatives": OP11_SQL, "op12_spelling_variants": OP12_SQL}
