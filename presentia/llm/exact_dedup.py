"""Exact deduplication by deterministic block naming (DataFrame functions only).

A text, stripped of the white space ``[\\x20\\x09-\\x0D]``, is cut into blocks of a fixed number of bytes.
The distinct blocks are sorted and numbered: a block's number is its *name*. Adjacent names are then
paired, the distinct pairs are sorted and numbered in turn, and so on until one name is left for each
text. Numbering is injective at every level, so two texts share (level, name) iff they are equal: no
digest has to be trusted.

Scale. Blocks travel through one shuffle only, after map-side distinct, keyed by a 64-bit hash that
routes and joins but does not decide: hashes shared by different blocks are found and those blocks are
joined on their bytes. After level 0 only integers move. A group of copies of any size is reduced
before each shuffle; the joins back are plain sort-merge joins, which adaptive execution splits when
one name is hot. The number of levels is log2 of the blocks of the longest text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presentia.plans.materialize import materialize

WHITE_SPACE = " \n\t\r\x0b\x0c"
#: Stands for the missing right half of the last pair of an odd row of names.
NO_NAME = -(2**63)


def stripped(text: Column) -> Column:
    """``text`` without any white-space character; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for ch in WHITE_SPACE:
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def _blocks(norm: Column, block_bytes: int) -> Column:
    last = F.greatest(F.ceil(F.octet_length(norm) / F.lit(block_bytes)).cast("int"), F.lit(1)) - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(norm, i * block_bytes + 1, F.lit(block_bytes)))


def _hashes(norm: Column, block_bytes: int, block_hash: Callable[[Column], Column]) -> Column:
    return F.transform(_blocks(norm, block_bytes), lambda b: block_hash(b))


def _pair_names(pairs: DataFrame, tag: str) -> DataFrame:
    """Sorted distinct (l, r), numbered."""
    distinct = pairs.select("l", "r").distinct().sortWithinPartitions("l", "r")
    return materialize(distinct.select("l", "r", F.monotonically_increasing_id().alias("name")), tag)


def identities(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = 4096,
    block_hash: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row for each row of ``docs``: row_id, doc_id, n_cp, text_sha256, level, name.

    ``block_hash`` only routes; a poor one costs time, never a result.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    norm = src.withColumn("bin", stripped(F.col("text")).cast("binary"))
    cut = norm.select(
        F.monotonically_increasing_id().alias("row_id"),
        "doc_id",
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_cp"),
        F.sha2("bin", 256).alias("text_sha256"),
        _hashes(F.col("bin"), block_bytes, block_hash).alias("hs"),
    )
    rows = materialize(cut, "dedup-rows")

    blocks = norm.select(F.explode(_blocks(F.col("bin"), block_bytes)).alias("block")).select(block_hash(F.col("block")).alias("h"), "block")
    ordered = blocks.distinct().sortWithinPartitions("h", "block")
    named = materialize(ordered.select("h", F.monotonically_increasing_id().alias("name")), "dedup-names")
    clash = materialize(named.groupBy("h").count().filter("count > 1").select("h"), "dedup-clash")

    at = rows.select("row_id", F.size("hs").alias("n"), F.posexplode("hs").alias("pos", "h"))
    if clash.isEmpty():
        cur = at.join(named, "h").select("row_id", "n", "pos", "name")
    else:
        # Different blocks under one hash: named by their bytes, from a range of their own. The blocks are read from
        # the texts again and go to the written rows of their id, digest and block hashes.
        full = norm.select("doc_id", F.sha2("bin", 256).alias("sha"), _hashes(F.col("bin"), block_bytes, block_hash).alias("hs"), F.posexplode(_blocks(F.col("bin"), block_bytes)).alias("pos", "block"))
        odd = materialize(full.withColumn("h", block_hash(F.col("block"))).join(clash, "h", "left_semi").drop("h").distinct(), "dedup-odd")
        odd_names = odd.select("block").distinct().sortWithinPartitions("block")
        odd_names = materialize(odd_names.select("block", (-1 - F.monotonically_increasing_id()).alias("name")), "dedup-odd-names")
        odd = odd.join(odd_names, "block").select(F.col("doc_id").alias("odd_id"), "sha", F.col("hs").alias("odd_hs"), "pos", "name")
        mine = rows["doc_id"].eqNullSafe(odd["odd_id"]) & (rows["text_sha256"] == odd["sha"]) & (rows["hs"] == odd["odd_hs"])
        odd_at = rows.join(odd, mine).select("row_id", "pos", "name")
        counts = rows.select("row_id", F.size("hs").alias("n"))
        plain = at.join(clash, "h", "left_anti").join(named, "h").select("row_id", "n", "pos", "name")
        cur = plain.unionByName(odd_at.join(counts, "row_id").select("row_id", "n", "pos", "name"))
    cur = materialize(cur, "dedup-level")

    longest = rows.agg(F.max(F.size("hs"))).first()[0] or 1
    done = cur.filter("n = 1").select("row_id", F.lit(0).alias("level"), "name")
    level = 0
    while longest > 1:
        level, longest = level + 1, -(-longest // 2)
        even = F.col("pos") % 2 == 0
        pairs = (
            cur.filter("n > 1")
            .groupBy("row_id", F.floor(F.col("pos") / 2).cast("int").alias("pos"))
            .agg(
                F.ceil(F.max("n") / 2).cast("int").alias("n"),
                F.max(F.when(even, F.col("name"))).alias("l"),
                F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(NO_NAME)).alias("r"),
            )
        )
        pairs = materialize(pairs, f"dedup-pairs{level}")
        cur = materialize(pairs.join(_pair_names(pairs, f"dedup-names{level}"), ["l", "r"]).select("row_id", "n", "pos", "name"), f"dedup-level{level}")
        done = done.unionByName(cur.filter("n = 1").select("row_id", F.lit(level).alias("level"), "name"))
    return materialize(rows.drop("hs").join(done, "row_id"), "dedup-ids")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096) -> DataFrame:
    """Groups equal texts; returns doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    Of a group the row with the most code points in the original text stays, then the smallest doc_id
    (null after all others), then the first row read. Null texts count as empty; empty texts are equal to
    each other and to texts of white space only. Repeated rows are copies of each other: one is kept.
    Very long texts are compared whole. Other columns of ``docs``, whatever their names, are ignored; an empty
    table gives an empty result.
    """
    ids = identities(docs, id_col, text_col, block_bytes)
    rank = F.struct((-F.col("n_cp")).alias("less"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("row_id").alias("row_id"))
    groups = ids.groupBy("level", "name").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.filter("group_size > 1").select("level", "name", F.col("best.doc_id").alias("keep_id"), F.col("best.row_id").alias("keep_row"), "group_size")
    # Written, so that the join below is one of two scans: adaptive execution splits a hot name there.
    groups = materialize(groups, "dedup-groups")
    lone = F.col("keep_row").isNull()
    return ids.join(groups, ["level", "name"], "left").select(
        "doc_id",
        F.when(lone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (lone | (F.col("row_id") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all their columns as they are.

    Null, empty and blank texts are copies of each other, very long ones are compared whole, ties go to the
    smallest id, of repeated rows one stays, an empty table stays empty. The user's columns travel in one
    struct, so that none of their names is taken.
    """
    found = exact_dedup(docs, id_col, text_col)
    kept = found.filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    mine = docs.select(row, docs[id_col].alias("id"), F.sha2(stripped(docs[text_col]).cast("binary"), 256).alias("sha"))
    hit = mine.join(kept, mine["id"].eqNullSafe(kept["kept_id"]) & (mine["sha"] == kept["kept_sha"]), "left_semi")
    # Rows that repeat both id and text pass the join together; the longest of them is the kept one. Tasks reduce
    # theirs before the shuffle, however many there are.
    several = found.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("more_id"), F.col("text_sha256").alias("more_sha"))
    several = materialize(several, "dedup-several")
    if several.isEmpty():
        return hit.select("row.*")
    same = mine["id"].eqNullSafe(several["more_id"]) & (mine["sha"] == several["more_sha"])
    longest = hit.join(several, same, "left_semi").groupBy("id", "sha").agg(F.max_by("row", F.length(F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")))).alias("row"))
    return hit.join(several, same, "left_anti").select("row.*").unionByName(longest.select("row.*"))
