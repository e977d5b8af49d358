"""Substring deduplication with compressed FM-indexes of bounded shards.

A word goes if a window of ``window`` consecutive words that covers it also starts in a document with a
smaller doc_id. To index every passage against every shard would be quadratic in the shards, so passages
meet where they can match at all:

1. Each window is represented by its *anchor*, the smallest hash of the word grams inside it. Equal windows
   have equal anchors. Runs of windows with one anchor form a *segment* of the document.
2. Anchors that occur in two documents are counted out, after map-side reduction; segments of the others
   cannot repeat and are dropped. Equal segments are reduced to one with its smallest doc_id.
3. The distinct segments go to shards by anchor. A shard builds an FM-index of its segments' words: a
   Burrows-Wheeler transform in a bit-packed wavelet matrix with rank samples, and a sampled suffix array.
   The segments stream through it: every window is searched backwards, all windows of a batch in step; a
   window's matching statistic is how far the search gets before its interval holds nothing but itself.
   Windows that reach the full length report the smallest doc_id of their interval.
4. What the shards report goes back to all copies of a segment, then to the documents.

An anchor with very many distinct segments (a common line in ever new surroundings) would fill a shard. Its
segments are documents of their own to the same procedure with finer anchors: a second, third ... hash of the
grams joins the first. Equal windows still meet; windows that differ part. Shards are sized by the words they
hold, so their number grows with the corpus and their memory does not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presentia.llm.arrow_text import bounded, joined
from presentia.llm.shingles import gram_hashes, mixed, word_hashes
from presentia.plans.materialize import materialize, partitions_for, release

WINDOW, GRAM = 13, 6
#: Words of distinct segments in a shard.
SHARD_WORDS = 1_000_000
#: Distinct segments of one anchor from which its anchors are made finer, as long as that leaves at most this share of them together.
HOT_SEGMENTS, SHRINKING = 1000, 0.9
#: Every how many positions the suffix array is kept.
SAMPLE = 8


class WaveletMatrix:
    """Rank over a sequence of numbers: one bit-packed level for each bit, with a count before each word."""

    def __init__(self, values: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.n = len(values)
        self.bits, self.before, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = ((values >> level) & 1).astype(np.uint8)
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.bits.append(words)
            self.before.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words))[:-1])).astype(np.uint32))
            self.zeros.append(int(self.n - bit.sum(dtype=np.int64)))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, values: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each value occurs before each end."""
        at = ends.astype(np.int64)
        start = np.zeros(len(values), np.int64)
        for k in range(self.levels):
            level = self.levels - 1 - k
            one = ((values >> level) & 1).astype(bool)
            a, b = self._ones(k, start), self._ones(k, at)
            z = self.zeros[k]
            start = np.where(one, z + a, start - a)
            at = np.where(one, z + b, at - b)
        return at - start

    def bit(self, k: int, i: np.ndarray) -> np.ndarray:
        return (self.bits[k][i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at the places, and how often each occurs before its place."""
        at, start, value = i.astype(np.int64), np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for k in range(self.levels):
            one = self.bit(k, at)
            a, b, z = self._ones(k, start), self._ones(k, at), self.zeros[k]
            value = value << 1 | one
            start = np.where(one, z + a, start - a)
            at = np.where(one, z + b, at - b)
        return value, at - start

    def _ones(self, k: int, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[k][w].astype(np.int64) + np.bitwise_count(self.bits[k][w] & mask)


class FMIndex:
    """Backward search over a text of numbers, and the places of what it finds from a sampled suffix array.

    ``stops`` are places that are kept besides every ``every``-th one, so that no walk passes them.
    """

    def __init__(self, text: np.ndarray, sigma: int, every: int = SAMPLE, stops: np.ndarray | None = None):
        n = len(text)
        rank, reach = text.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while True:
            after = np.zeros(n, np.int64)
            after[: n - reach] = rank[reach:] + 1
            key = rank * (int(rank.max(initial=0)) + 2) + after
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate(([0], sorted_key[1:] != sorted_key[:-1])))
            reach *= 2
            if reach >= n or rank[order[-1]] == n - 1:
                break
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        self.wavelet = WaveletMatrix(text[order - 1], sigma)  # position -1 is the final separator
        kept = order % every == 0
        if stops is not None:
            at = np.zeros(n, bool)
            at[stops] = True
            kept |= at[order]
        self.kept = WaveletMatrix(kept.astype(np.int64), 2)
        self.samples = order[kept].astype(np.uint32)

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns that have ``symbols`` before those of [lo, hi)."""
        ranks = self.wavelet.rank(np.concatenate([symbols, symbols]), np.concatenate([lo, hi]))
        base = self.starts[symbols]
        return base + ranks[: len(lo)], base + ranks[len(lo) :]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where in the text the suffixes of the rows start: steps to the left until a kept one."""
        out = np.zeros(len(rows), np.int64)
        live, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(live):
            bit = self.kept.bit(0, at)
            out[live[bit]] = self.samples[self.kept._ones(0, at[bit])] + steps
            live, at = live[~bit], at[~bit]
            symbols, ranks = self.wavelet.access(at)
            at, steps = self.starts[symbols] + ranks, steps + 1
        return out


def matching_statistics(index: FMIndex, text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For patterns that end at ``ends`` (inclusive): how many symbols backwards still occur elsewhere too, at most ``length``, and the final intervals."""
    stat = np.zeros(len(ends), np.int64)
    lo, hi = index.starts[text[ends]].copy(), index.starts[text[ends] + 1].copy()
    live = np.flatnonzero(hi - lo > 1)
    stat[live] = 1
    for step in range(1, length):
        if not len(live):
            break
        lo[live], hi[live] = index.extend(text[ends[live] - step], lo[live], hi[live])
        live = live[hi[live] - lo[live] > 1]
        stat[live] = step + 1
    return stat, lo, hi


def shard_reports(segments: list[bytes], first_docs: np.ndarray, window: int = WINDOW) -> list[list[int]]:
    """For each segment the windows (numbered from 0) that also occur in a segment with a smaller first doc."""
    parts = [s + b"\n" for s in segments]
    whole = b"".join(parts)
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    hashes, at, _, _ = word_hashes(whole, offsets)
    _, ids = np.unique(hashes, return_inverse=True)
    lengths = np.diff(at)
    places = np.arange(len(ids)) + np.repeat(np.arange(len(segments)), lengths)  # one separator after each segment
    text = np.zeros(len(ids) + len(segments), np.int64)
    text[places] = ids + 1
    sigma = int(ids.max()) + 2 if len(ids) else 1
    begin = at[:-1] + np.arange(len(segments))
    index = FMIndex(text, sigma, stops=begin[lengths > 0])
    counts = np.maximum(lengths - window + 1, 0)
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    seg = np.repeat(np.arange(len(segments)), counts)
    ends = begin[seg] + number + window - 1
    stat, lo, hi = matching_statistics(index, text, ends, window)
    out: list[list[int]] = [[] for _ in segments]
    full = np.flatnonzero(stat >= window)
    if len(full):
        # Intervals of equal length patterns are equal or disjoint: each is located once.
        bounds, which = np.unique(lo[full], return_inverse=True)
        sizes = np.zeros(len(bounds), np.int64)
        sizes[which] = (hi - lo)[full]
        offset = np.cumsum(sizes) - sizes
        rows = np.repeat(bounds - offset, sizes) + np.arange(sizes.sum())
        found = first_docs[np.searchsorted(begin, index.locate(rows), "right") - 1]
        low = np.minimum.reduceat(found, offset)
        for k in full[low[which] < first_docs[seg[full]]].tolist():
            out[int(seg[k])].append(int(number[k]))
    return out


def _anchors(docs: DataFrame, window: int, gram: int, level: int) -> DataFrame:
    """(anchor, body, doc_id, tid, start, n) for each segment: ``body`` is a hash of its words, n its windows.

    The anchor is made of the smallest of ``level`` + 1 hashes of the window's grams.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "text"):
            whole, offsets = joined(b.column("text"))
            words, at, _, _ = word_hashes(whole, offsets)
            if len(words) < window:
                continue
            grams = gram_hashes(words, gram)
            low = np.zeros(len(words) - window + 1, np.uint64)
            for finer in range(level + 1):
                least = grams[: len(low)].copy()
                for k in range(1, window - gram + 1):
                    np.minimum(least, grams[k : k + len(low)], out=least)
                low = mixed(low * np.uint64(_BASE) + least) if level else least
                grams = mixed(grams + np.uint64(finer + 1))
            doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
            inside = doc[: len(low)] == doc[window - 1 :]
            new = inside.copy()
            new[1:] &= ~inside[:-1] | (low[1:] != low[:-1]) | (doc[1 : len(low)] != doc[: len(low) - 1])
            first = np.flatnonzero(new)
            if not len(first):
                continue
            windows = np.add.reduceat(inside, first, dtype=np.int64)
            # A positional sum over the segment's words, from prefix sums.
            sums = np.zeros(len(words) + 1, np.uint64)
            np.cumsum(mixed(words) * _powers_to(len(words)), out=sums[1:])
            body = mixed((sums[first + windows + window - 1] - sums[first]) * _inverse_at(first) + windows.astype(np.uint64))
            owner = doc[first]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(low[first].view(np.int64)),
                    pa.array(body.view(np.int64)),
                    b.column("doc_id").take(pa.array(owner)),
                    b.column("tid").take(pa.array(owner)),
                    pa.array((first - at[owner]).astype(np.int32)),
                    pa.array(windows.astype(np.int32)),
                ],
                names=["anchor", "body", "doc_id", "tid", "start", "n"],
            )

    return docs.filter("doc_id is not null").mapInArrow(run, "anchor bigint, body bigint, doc_id bigint, tid bigint, start int, n int")


_BASE = 0xC2B2AE3D27D4EB4F


def _powers_to(n: int) -> np.ndarray:
    """The powers of an odd base."""
    p = np.full(n, _BASE, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def _inverse_at(at: np.ndarray) -> np.ndarray:
    """The inverse powers at the given positions."""
    p = np.full(int(at.max()) + 1, pow(_BASE, -1, 2**64), np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)[at]


def _contents(docs: DataFrame, segments: DataFrame, window: int) -> DataFrame:
    """(anchor, body, first_doc, content, hot): the words of the distinct segments, from their first documents."""
    marked = segments.groupBy("doc_id", "tid").agg(F.collect_list(F.struct("anchor", "body", "start", "n", "hot")).alias("segments"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "text"):
            whole, offsets = joined(b.column("text"))
            _, at, begin, end = word_hashes(whole, offsets)
            rows = []
            for doc_id, found, base in zip(b.column("doc_id").to_pylist(), b.column("segments").to_pylist(), at.tolist(), strict=False):
                for s in found:
                    i = base + s["start"]
                    rows.append((s["anchor"], s["body"], doc_id, whole[begin[i] : end[i + s["n"] + window - 2]], s["hot"]))
            if rows:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["anchor", "body", "first_doc", "content", "hot"])

    return docs.join(marked, ["doc_id", "tid"]).select("doc_id", "text", "segments").mapInArrow(run, "anchor bigint, body bigint, first_doc bigint, content binary, hot boolean")


def _reports(contents: DataFrame, n_words: int, window: int) -> DataFrame:
    """(anchor, body, hit): the windows of distinct segments that also occur under a smaller first doc."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for b in batches:  # rows that repeat an id bring their segments again
            for anchor, body, doc, content in zip(*(b.column(c).to_pylist() for c in ("anchor", "body", "first_doc", "content")), strict=True):
                held.setdefault((anchor, body), (doc, content))
        if not held:
            return
        keys = list(held)
        found = shard_reports([c for _, c in held.values()], np.array([d for d, _ in held.values()], np.int64), window)
        some = [k for k, hits in enumerate(found) if hits]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([keys[k][i] for k in some], pa.int64()) for i in (0, 1)), pa.array([found[k] for k in some], pa.list_(pa.int32()))], names=["anchor", "body", "hits"]
        )

    shards = partitions_for(n_words, SHARD_WORDS, 1)
    plain = contents.select("anchor", "body", "first_doc", "content").repartition(shards, "anchor")
    return plain.mapInArrow(run, "anchor bigint, body bigint, hits array<int>").select("anchor", "body", F.explode("hits").alias("hit"))


def _finer_reports(contents: DataFrame, window: int, gram: int, level: int, most: int) -> DataFrame:
    """The same for segments of hot anchors, ``most`` of one: documents of their own, whose anchors are finer."""
    own = contents.select("anchor", "body", F.col("first_doc").alias("doc_id"), F.xxhash64("anchor", "body").alias("tid"), F.col("content").alias("text")).dropDuplicates(["anchor", "body"])
    own = materialize(own, "sub-hot")
    spans = covered_windows(own.select("doc_id", "tid", "text"), window, gram, level, most)
    windows = spans.select("doc_id", "tid", F.explode("spans").alias("s")).select("doc_id", "tid", F.explode(F.sequence(F.col("s.start"), F.col("s.start") + F.col("s.n") - 1)).alias("hit"))
    return own.select("anchor", "body", "doc_id", "tid").join(windows, ["doc_id", "tid"]).select("anchor", "body", "hit").distinct()


def covered_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, level: int = 0, most: int = 1 << 62) -> DataFrame:
    """(doc_id, tid, spans array<struct<start, n>>): the repeated windows of each document that has any; written.

    ``docs``: doc_id, tid, text. A span is a run of n windows that starts at word ``start``. ``most`` distinct segments
    shared an anchor on the level before; the levels end where no anchor is hot, or where finer ones part no segments.
    """
    anchors = materialize(_anchors(docs, window, gram, level), "sub-anchors")
    repeated = anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("anchor")
    repeated = materialize(repeated, "sub-repeated")
    segments = materialize(anchors.join(repeated, "anchor", "left_semi"), "sub-segments")
    release(anchors)
    distinct = segments.groupBy("anchor", "body").agg(F.min(F.struct("doc_id", "tid", "start", "n")).alias("s"))
    distinct = materialize(distinct.select("anchor", "body", "s.doc_id", "s.tid", "s.start", "s.n"), "sub-distinct")
    # A single distinct segment has no other to match: its copies are covered, its first one is not.
    shared = distinct.groupBy("anchor").count().filter("count > 1").select("anchor", F.col("count").alias("mates"), ((F.col("count") > HOT_SEGMENTS) & (F.col("count") <= SHRINKING * most)).alias("hot"))
    wanted = materialize(distinct.join(shared, "anchor"), "sub-wanted")
    n_words, hottest = wanted.agg(F.coalesce(F.sum(F.when(~F.col("hot"), F.col("n") + (window - 1))), F.lit(0)), F.max(F.when(F.col("hot"), F.col("mates")))).first()
    contents = materialize(_contents(docs, wanted, window), "sub-contents")
    reports = materialize(_reports(contents.filter("not hot"), n_words, window), "sub-reports")
    if hottest:
        reports = reports.unionByName(materialize(_finer_reports(contents.filter("hot"), window, gram, level + 1, hottest), "sub-finer"))
    release(contents)
    firsts = distinct.select("anchor", "body", F.col("doc_id").alias("first_doc"))
    here = segments.join(firsts, ["anchor", "body"])
    whole = here.filter("doc_id > first_doc").select("doc_id", "tid", "start", "n")
    partly = here.filter("doc_id = first_doc").join(reports, ["anchor", "body"]).select("doc_id", "tid", (F.col("start") + F.col("hit")).alias("start"), F.lit(1).alias("n"))
    # Sets: rows that repeat an id and text say the same again.
    return materialize(whole.unionByName(partly).groupBy("doc_id", "tid").agg(F.collect_set(F.struct("start", "n")).alias("spans")), "sub-spans")


def _removed(n_words: int, spans: list | None, window: int) -> np.ndarray:
    """Which words the spans cover."""
    mark = np.zeros(n_words + 1, np.int64)
    for s in spans or ():
        mark[s["start"]] += 1
        mark[s["start"] + s["n"] + window - 1] -= 1
    return np.cumsum(mark)[:n_words] > 0


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and ``kept_text``), for every row.

    Words are runs without [\\x20\\x09-\\x0D]; null texts have none. Rows with a null doc_id neither remove nor
    lose words. Rows that repeat a doc_id do not remove each other's words, as none is smaller. Very long texts
    are cut into segments like others. An empty table gives an empty result. Other columns, whatever their
    names, are not read.
    """
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tid", F.xxhash64("text"))
    spans = covered_windows(src, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "text", 4 << 20):
            rows = []
            for text, found in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                words = text.split()
                gone = _removed(len(words), found, window) if found else np.zeros(0, bool)
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if found else words)
                rows.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    out = src.join(spans, ["doc_id", "tid"], "left").select("doc_id", "text", "spans")
    out = out.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")
    return out if with_text else out.drop("kept_text")
