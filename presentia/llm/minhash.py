"""Near-duplicates by MinHash with sequential Bayesian verification.

1. Each document becomes its set of distinct word shingles, a 128-bit key of the set and a signature.
   Documents with equal sets form a class; only class representatives go on.
2. Signatures are cut into bands; representatives that agree on a band share a bucket. With 32 bands of
   4 values a pair at similarity 0.8 shares none with probability 5e-8.
3. A bucket does not emit its pairs. It links its members to one pivot, its smallest member, which grows
   linearly however many share the bucket. Buckets whose members are not one component by then go on:
   see :func:`_crossing`.
4. Candidates are verified sequentially: their signatures are compared batch by batch, and a pair is
   dropped as soon as the posterior probability that it reaches the threshold falls under ``MISS``.
5. Survivors are confirmed on their full shingle sets. Links are exact; what can be missed is bounded by
   the bands and ``MISS``.

Sets are built twice, for signatures and for the survivors' documents only; they are never stored for
all. Hot buckets and hot pivots are plain equi-joins that adaptive execution splits.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presentia.llm.arrow_text import bounded, joined
from presentia.llm.components import components
from presentia.llm.shingles import LOWER, mixed, shingle_sets
from presentia.plans.materialize import materialize

BANDS, ROWS = 32, 4
VALUES = BANDS * ROWS
BATCH = 16
#: Probability at which a pair may be pruned although it reaches the threshold.
MISS = 1e-6
_MULTIPLIERS = mixed(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_ADDENDS = mixed(_MULTIPLIERS)
#: Shingles whose signature values are computed at a time.
_SLAB = 2048


def signature(grams: np.ndarray) -> np.ndarray:
    """The minimum of each hash function over a set, as 32-bit values."""
    low = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(grams), _SLAB):
        slab = grams[i : i + _SLAB, None] * _MULTIPLIERS
        slab += _ADDENDS
        np.minimum(low, slab.min(axis=0), out=low)
    return (low >> np.uint64(32)).astype("<u4")


@functools.cache
def least_matches(percent: int, miss: float = MISS) -> list[int]:
    """How many of the first 1, 2, ... batches' values must agree for a pair to go on.

    With a uniform prior and m of n values equal, the similarity is Beta(m + 1, n - m + 1), and the chance
    that it reaches t is that of at most m successes in n + 1 draws of probability t.
    """
    t = percent / 100
    out = []
    for n in range(BATCH, VALUES + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss and m < n:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def _set_key(grams: np.ndarray) -> bytes | None:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None


def signatures(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_key (empty sets: null), sig; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "text"):
            whole, offsets = joined(b.column("text"))
            sets = shingle_sets(whole.translate(LOWER), offsets, size)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_set_key(s) for s in sets], pa.binary()),
                    pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "set_key", "sig"],
            )

    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return materialize(src.mapInArrow(run, "doc_id bigint, n_shingles bigint, set_key binary, sig binary"), "near-signatures")


def _buckets(classes: DataFrame) -> DataFrame:
    """(key, band, cid) for each band of each class."""
    cut = classes.select("cid", "sig", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    return cut.select(F.xxhash64(F.substring(F.col("sig"), F.col("band") * (4 * ROWS) + 1, F.lit(4 * ROWS)), F.col("band")).alias("key"), "band", "cid")


def survivors(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that set sizes and the sequential Bayesian test leave."""
    need = least_matches(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keep = np.arange(batch.num_rows)
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, VALUES) for c in ("sig_a", "sig_b"))
            matches = np.zeros(len(keep), np.int64)
            for k, least in enumerate(need):
                cols = slice(k * BATCH, (k + 1) * BATCH)
                matches = matches + (x[keep, cols] == y[keep, cols]).sum(axis=1)
                passed = matches >= least
                keep, matches = keep[passed], matches[passed]
            yield batch.select(["a", "b"]).take(pa.array(keep))

    sizes = classes.select("cid", "n_shingles")
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    sized = pairs.join(sizes.toDF("a", "n_a"), "a").join(sizes.toDF("b", "n_b"), "b").filter(fits).select("a", "b")
    sigs = classes.select("cid", "sig")
    full = sized.join(sigs.toDF("a", "sig_a"), "a").join(sigs.toDF("b", "sig_b"), "b").select("a", "b", "sig_a", "sig_b")
    return materialize(full.mapInArrow(run, "a bigint, b bigint"), "near-survivors")


def shingle_table(docs: DataFrame, wanted: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(cid, grams): the full sets of the wanted classes (cid, doc_id, set_key), each from its smallest document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "text"):
            whole, offsets = joined(b.column("text"))
            sets = shingle_sets(whole.translate(LOWER), offsets, size)
            # An id may stand on several texts: only the text that has the class's set speaks for it.
            rows = [(c, s.tobytes()) for c, k, s in zip(b.column("cid").to_pylist(), b.column("set_key").to_pylist(), sets, strict=True) if _set_key(s) == k]
            if rows:
                cids, grams = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(grams, pa.binary())], names=["cid", "grams"])

    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return materialize(src.join(wanted, "doc_id").select("cid", "set_key", "text").mapInArrow(run, "cid bigint, grams binary"), "near-sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs whose full sets reach the threshold."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * both >= percent * (len(u) + len(v) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    full = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return materialize(full.mapInArrow(test, "a bigint, b bigint"), "near-links")


class _Merged:
    """Components of one bucket's classes, so that links which join nothing new are not passed on."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _block_links(x: dict, y: dict | None, band: int, percent: int) -> Iterator[tuple[int, int]]:
    """Links between the members of two blocks of a bucket (or within one) that join different components."""
    same = y is None
    y = x if same else y
    open_ = x["component"][:, None] != y["component"][None, :]
    if same:
        open_ &= np.tri(len(x["cid"]), k=-1, dtype=bool)
    open_ &= 100 * np.minimum.outer(x["n"], y["n"]) >= percent * np.maximum.outer(x["n"], y["n"])
    for k in range(band):  # a pair is tested in the first bucket it shares
        if not open_.any():
            return
        open_ &= x["bands"][:, k][:, None] != y["bands"][:, k][None, :]
    matches = np.zeros(open_.shape, np.int16)
    for k, least in enumerate(least_matches(percent)):
        if not open_.any():
            return
        for c in range(k * BATCH, (k + 1) * BATCH):
            matches += x["sig"][:, c][:, None] == y["sig"][:, c][None, :]
        open_ &= matches >= least
    merged = _Merged()
    for i in np.flatnonzero(open_.any(axis=1)).tolist():
        others = np.flatnonzero(open_[i])
        mine = x["grams"][i]
        for j in others.tolist():
            a, b = int(x["component"][i]), int(y["component"][j])
            if merged.root(a) == merged.root(b):
                continue
            theirs = y["grams"][j]
            both = len(np.intersect1d(mine, theirs, assume_unique=True))
            if 100 * both >= percent * (len(mine) + len(theirs) - both) and merged.join(a, b):
                yield int(x["cid"][i]), int(y["cid"][j])


def _members(rows: list[tuple]) -> dict:
    """Columns of (cid, component, n_shingles, sig, grams) rows."""
    sig = np.frombuffer(b"".join(r[3] for r in rows), "<u4").reshape(-1, VALUES)
    return {
        "cid": np.array([r[0] for r in rows], np.int64),
        "component": np.array([r[1] for r in rows], np.int64),
        "n": np.array([r[2] for r in rows], np.int64),
        "sig": sig,
        "bands": np.ascontiguousarray(sig).view(np.dtype((np.void, 4 * ROWS))),
        "grams": [np.frombuffer(r[4], np.uint64) for r in rows],
    }


#: A block of a bucket: how many classes and how many shingles it holds on average.
BLOCK_CLASSES, BLOCK_SHINGLES = 512, 1_000_000


def _crossing(buckets: DataFrame, pivots: DataFrame, parts: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that the pivots have not shown, between members of one bucket in different components.

    All members of such a bucket but its pivot, which is tested already, are dealt into blocks of bounded
    size, and each pair of blocks is compared in one group: signatures as arrays, then the sets of what the
    Bayesian test leaves. No pair becomes a row unless it is a link that joins two components. Buckets
    whose members all are in one component, nearly all of them, are closed by an aggregate.
    """
    members = buckets.join(pivots.filter("n > 2"), "key").filter("cid <> pivot").select("key", "band", "cid")
    members = members.join(parts.toDF("cid", "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    members = members.join(classes.select("cid", "n_shingles"), "cid")
    members = materialize(members, "near-members")
    still = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s")).filter("lo <> hi")
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_CLASSES, F.col("s") / BLOCK_SHINGLES)).cast("int")
    dealt = members.join(still.select("key", blocks.alias("blocks")), "key").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    dealt = dealt.join(classes.select("cid", "sig"), "cid").join(sets, "cid")
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("partner")
    dealt = dealt.select("key", "band", "block", "cid", "component", "n_shingles", "sig", "grams", partner)
    dealt = dealt.select("key", F.least("block", "partner").alias("lo"), F.greatest("block", "partner").alias("hi"), "band", "block", "cid", "component", "n_shingles", "sig", "grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, band, sides, found = None, 0, {}, []

        def end() -> None:
            if key is not None:
                blocks = [_members(sides[k]) for k in sorted(sides)]
                if key[1] == key[2]:
                    found.extend(_block_links(blocks[0], None, band, percent))
                elif len(blocks) == 2:
                    found.extend(_block_links(*blocks, band, percent))

        for batch in batches:
            cols = (batch.column(c).to_pylist() for c in ("key", "lo", "hi", "band", "block", "cid", "component", "n_shingles", "sig", "grams"))
            for k, lo, hi, b, block, *row in zip(*cols, strict=True):
                if (k, lo, hi) != key:
                    end()
                    key, band, sides = (k, lo, hi), b, {}
                sides.setdefault(block, []).append(row)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])
                found = []
        end()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    # A stage boundary of its own, so that block pairs of one hot bucket spread over the tasks.
    spread = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return materialize(spread.mapInArrow(run, "a bigint, b bigint"), "near-crossing")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links), kept, for every row.

    Two texts are linked if 100 * |A n B| >= percent * |A u B| of their sets of ``size``-word shingles. Texts
    with fewer words are one shingle; null and empty texts have no shingles and are linked with nothing.
    Repeated rows and copies have equal sets and are one class. Rows with a null doc_id are never the
    smallest: they take the component of their class if another row has an id, and are kept if none has.
    Rows that repeat a doc_id are kept or dropped together. Very long texts are compared whole. An empty table
    gives an empty result. Other columns, whatever their names, are not read.
    """
    sigs = signatures(docs, size, id_col, text_col)
    classes = sigs.filter("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "near-classes")
    buckets = materialize(_buckets(classes), "near-buckets")
    pivots = materialize(buckets.groupBy("key").agg(F.min("cid").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "near-pivots")
    pairs = materialize(buckets.join(pivots, "key").filter("cid <> pivot").select(F.col("cid").alias("a"), F.col("pivot").alias("b")).distinct(), "near-pairs")
    tried = survivors(pairs, classes, percent)
    open_members = buckets.join(pivots.filter("n > 2"), "key").filter("cid <> pivot").select("cid")
    wanted = tried.select(F.explode(F.array("a", "b")).alias("cid")).unionByName(open_members).distinct()
    sets = shingle_table(docs, classes.join(wanted, "cid").select("cid", "doc_id", "set_key"), size, id_col, text_col)
    links = confirmed(tried, sets, percent)
    parts = components(links, "near-parts")
    more = _crossing(buckets, pivots, parts, classes, sets, percent)
    if not more.isEmpty():
        parts = components(links.unionByName(more), "near-all-parts")
    own = classes.select("cid", "set_key", "doc_id").join(parts.toDF("cid", "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = own.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = materialize(own.join(least, "component").select("set_key", "component_id"), "near-named")
    some = sigs.filter("set_key is not null").join(named, "set_key").select("doc_id", "n_shingles", "component_id")
    none = sigs.filter("set_key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return some.unionByName(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that :func:`near_duplicates` keeps: one document of each group.

    Null and empty texts stay, each being a group of its own; very long texts are compared whole; of equal texts
    the smallest id stays; rows that repeat an id stay or go together; an empty table stays empty. The user's
    columns travel in one struct, so that none of their names is taken.
    """
    kept = near_duplicates(docs, size, percent).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    mine = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("id"))
    return mine.join(kept, mine["id"].eqNullSafe(kept["kept_id"]), "left_semi").select("row.*")
