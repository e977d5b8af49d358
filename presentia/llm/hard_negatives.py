"""Hard negatives by threshold joins of inner products, in the manner of L2AP.

1. Vectors are dealt into shards of bounded size by their id. A task holds one shard and streams the
   anchors past it; anchors are copied once for each shard.
2. A shard's inverted index holds, for each row, its strongest dimensions only. The weak rest is left
   out as long as its norm, the suffix norm, stays under half of the cosine that the anchors ask for.
3. The postings give partial scores of a block of anchors with all rows. A row's partial score plus its
   remaining norm bounds its score; rows whose bound is under the anchor's threshold are pruned.
4. What is left is verified on whole vectors from the highest bound down: the threshold is lowered step
   by step until the anchor's windows are full of rows that score at least as much, or its floor is
   reached. Nothing under the threshold can then belong to a window, so results are exact.
5. Floors come from a pilot: each anchor first meets one shard, and its fifth best score there is a lower
   bound of its fifth best score anywhere. The pilot is linear in the rows.

Anchors and positives give windows of negatives, so the join runs twice: for positives, among the rows of
the anchor's label, and for negatives, among the others. Equal vectors of one label are one entry in a
shard, with as many of their smallest ids as a window can hold: later ids lose every tie.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presentia.plans.materialize import materialize, partitions_for

#: Components that a shard holds on average (32,768 rows of 64).
SHARD_COMPONENTS = 1 << 21
#: Anchors that are accumulated at a time.
BLOCK = 64
#: The remaining norm is at most this share of the cosine asked for, in steps of ``STEP``.
REST_SHARE, STEP = 0.5, 0.05
#: What single precision may add to a bound on a cosine.
SLACK = 1e-5
#: Candidates verified before the threshold is lowered for the first time.
FIRST_LOOK = 32
#: Components beyond this have squares that a double cannot add up.
LARGEST = 1e140
LONG = (1 << 63) - 1
FOUND = "anchor_id bigint, positive_id bigint, other_id bigint, score bigint"


def inner_products(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors held as doubles, cut to what a long holds."""
    if not rows.size:
        return np.zeros(len(rows), np.int64)
    if np.linalg.norm(x) * np.linalg.norm(rows, axis=1).max() < 2**52:
        return (rows @ x).astype(np.int64)
    own = [int(v) for v in x]
    return np.array([max(-LONG - 1, min(LONG, sum(a * int(b) for a, b in zip(own, row, strict=True)))) for row in rows.tolist()], np.int64)


def _matrix(lists: list[pa.Array], width: int) -> np.ndarray:
    """Rows of equal or shorter vectors; missing components are zero."""
    out = np.zeros((sum(map(len, lists)), width))
    at = 0
    for a in lists:
        ends = a.offsets.to_numpy()
        flat = a.values.to_numpy(zero_copy_only=False)
        sizes = np.diff(ends)
        rows = np.repeat(np.arange(len(a)), sizes)
        out[at + rows, np.arange(len(rows)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat[ends[0] : ends[-1]]
        at += len(a)
    return out


class Index:
    """Postings of the dimensions that the suffix norm ``rest`` does not cover."""

    def __init__(self, unit: np.ndarray, rest: float):
        n, width = unit.shape
        strong = np.argsort(-np.abs(unit), axis=1, kind="stable")
        squares = np.take_along_axis(unit.astype(np.float64) ** 2, strong, axis=1)
        suffix = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]  # of this dimension and all weaker ones
        kept = suffix > rest * rest
        count = kept.sum(axis=1)
        self.remaining = np.sqrt(np.where(count < width, np.take_along_axis(suffix, np.minimum(count, width - 1)[:, None], axis=1)[:, 0], 0.0)) if width else np.zeros(n)
        indexed = np.zeros((n, width), bool)
        np.put_along_axis(indexed, strong, kept, axis=1)
        indexed &= unit != 0
        self.rows = n
        self.postings = [(rows := np.flatnonzero(indexed[:, d]), unit[rows, d]) for d in range(width)]

    def partial_scores(self, anchors: np.ndarray) -> np.ndarray:
        """[row, anchor]: what the indexed dimensions contribute to each cosine."""
        out = np.zeros((self.rows, len(anchors)), np.float32)
        for d, (rows, weights) in enumerate(self.postings):
            if len(rows):
                out[rows] += weights[:, None] * anchors[:, d][None, :]
        return out


class Shard:
    """The rows of one shard by label, equal vectors of a label held once, and indexes over ranges of them."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, copies: int):
        order = np.lexsort((ids, labels))
        ids, labels, vectors = ids[order], labels[order], np.ascontiguousarray(vectors[order])
        if len(ids) and vectors.shape[1]:
            keys = np.column_stack([labels.view(np.float64), vectors + 0.0]).view(np.dtype((np.void, 8 * (vectors.shape[1] + 1))))[:, 0]
            group = np.unique(keys, return_inverse=True)[1]
            by = np.argsort(group, kind="stable")  # ids ascend inside a group
            first = np.concatenate(([True], group[by][1:] != group[by][:-1]))
            nth = np.arange(len(by)) - np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))
            keep = np.sort(by[nth < copies])
            ids, labels, vectors = ids[keep], labels[keep], vectors[keep]
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.norms = np.linalg.norm(vectors, axis=1)
        self.unit = (vectors / np.where(self.norms > 0, self.norms, 1)[:, None]).astype(np.float32)
        self._indexes: dict[tuple[int, int, int], Index] = {}

    def range_of(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label, "left")), int(np.searchsorted(self.labels, label, "right"))

    def index(self, span: tuple[int, int], cosine: float) -> Index:
        """The index over a range of rows for anchors that ask for ``cosine`` at least."""
        steps = max(0, int(min(cosine, 1.0) * REST_SHARE / STEP))
        if (*span, steps) not in self._indexes:
            self._indexes = {k: v for k, v in self._indexes.items() if k[:2] == span}
            self._indexes[(*span, steps)] = Index(self.unit[slice(*span)], steps * STEP)
        return self._indexes[(*span, steps)]


def _best(ids: np.ndarray, scores: np.ndarray) -> list[int]:
    """Positions by score, highest first, then by id."""
    return np.lexsort((ids, ~scores)).tolist()


def fill_windows(shard: Shard, rows: np.ndarray, bounds: np.ndarray, x: np.ndarray, windows: list[tuple[int | None, int | None]], size: int, skip: int | None) -> list[list[tuple[int, int]]]:
    """For each window (least, most) of scores its first ``size`` rows (id, score) among ``rows``.

    ``bounds`` are upper bounds of the rows' scores. The threshold starts at the highest and is lowered
    until every window holds ``size`` rows that score no less than it.
    """
    order = np.argsort(-bounds, kind="stable")
    rows, bounds = rows[order], bounds[order]
    ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    out: list[list[tuple[int, int]]] = [[] for _ in windows]
    at, look = 0, FIRST_LOOK
    while at < len(rows):
        new = rows[at : at + look]
        new = new[shard.ids[new] != skip] if skip is not None else new
        ids, scores = np.concatenate([ids, shard.ids[new]]), np.concatenate([scores, inner_products(x, shard.vectors[new])])
        at, look = at + look, look * 4
        threshold = bounds[at] if at < len(rows) else -np.inf
        ranked = _best(ids, scores)
        full = True
        for k, (least, most) in enumerate(windows):
            out[k] = []
            for r in ranked:
                if (most is None or scores[r] <= most) and (least is None or scores[r] >= least):
                    out[k].append((int(ids[r]), int(scores[r])))
                    if len(out[k]) == size:
                        break
            full &= len(out[k]) == size and out[k][-1][1] > threshold
        if full:
            break
    return out


def _probe(rows: DataFrame, anchors: DataFrame, shards: int, width: int, scale: float, copies: int, size: int, percent: int | None) -> DataFrame:
    """Each anchor's windows among the rows of each shard that it is sent to; written.

    ``anchors`` has id, label, x, floor, positives and shard. Without ``percent`` the window is the first
    ``size`` rows of the anchor's label; with it, the rows of other labels that score from ``percent``
    hundredths of a positive's score up to that score.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        shard: Shard | None = None
        for batch in batches:
            kinds = batch.column("kind").to_numpy(zero_copy_only=False)
            n = int((kinds == 0).sum())
            if n:
                held.append(batch.slice(0, n))
            if n == len(kinds):
                continue
            if shard is None:
                ids, labels = (np.concatenate([b.column(c).to_numpy() for b in held]) if held else np.zeros(0, np.int64) for c in ("id", "label"))
                shard = Shard(ids, labels, np.floor(scale * _matrix([b.column("x") for b in held], width)), copies)
                held = []
            if len(shard.ids):
                yield from answers(shard, batch.slice(n))

    def answers(shard: Shard, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, labels, floors, wanted = (batch.column(c).to_pylist() for c in ("id", "label", "floor", "positives"))
        vectors = np.floor(scale * _matrix([batch.column("x")], width))
        norms = np.linalg.norm(vectors, axis=1)
        unit = (vectors / np.where(norms > 0, norms, 1)[:, None]).astype(np.float32)
        longest, everything = shard.norms.max(), np.arange(len(shard.ids))
        start, found = 0, []
        while start < len(ids):
            stop = start + 1
            while stop < min(len(ids), start + BLOCK) and (percent is not None or labels[stop] == labels[start]):
                stop += 1
            span = shard.range_of(labels[start]) if percent is None else (0, len(shard.ids))
            if span[0] == span[1]:
                start = stop
                continue
            asked = [-1.0 if floors[k] is None or not norms[k] or not longest else floors[k] / (norms[k] * longest) for k in range(start, stop)]
            index = shard.index(span, min(asked))
            partial = index.partial_scores(unit[start:stop])
            own = everything[slice(*span)]
            for k in range(start, stop):
                bounds = (partial[:, k - start] + index.remaining + SLACK) * (shard.norms[own] * norms[k])
                passed = bounds >= (-np.inf if floors[k] is None else floors[k])
                if percent is None:
                    windows: list[tuple[int | None, int | None]] = [(floors[k], None)]
                else:
                    lo, hi = shard.range_of(labels[k])
                    passed[lo:hi] = False
                    windows = [(-(-percent * p["score"] // 100), p["score"]) for p in wanted[k]]
                chosen = own[passed]
                filled = fill_windows(shard, chosen, bounds[passed], vectors[k], windows, size, ids[k] if percent is None else None)
                for j, window in enumerate(filled):
                    positive = None if percent is None else wanted[k][j]["id"]
                    found += [(ids[k], positive, other, score) for other, score in window]
            start = stop
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["anchor_id", "positive_id", "other_id", "score"])

    none = F.array().cast("array<struct<id:bigint,score:bigint>>")
    shard_of = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")
    both = rows.select(F.lit(0).alias("kind"), "id", "label", "x", F.lit(None).cast("bigint").alias("floor"), none.alias("positives"), shard_of)
    both = both.unionByName(anchors.select(F.lit(1).alias("kind"), "id", "label", "x", "floor", "positives", "shard"))
    dealt = both.repartitionById(shards, F.col("shard"))
    ordered = dealt.sortWithinPartitions("kind", *([] if percent is not None else ["label"]), F.desc_nulls_last("floor"))
    return materialize(ordered.drop("shard").mapInArrow(run, FOUND), "negatives-found")


def _first(found: DataFrame, by: list[str], size: int) -> DataFrame:
    """The first ``size`` rows of each group by score, then id; groups hold what the shards' windows held."""
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "other_id")))
    return ranked.filter(F.col("rank") <= size)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column | None = None, scale: float = 1.0, positives: int = 5, negatives: int = 5, percent: int = 80, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x). An anchor's positives are its first ``positives`` other rows of its
    label by inner product, ties by id; for each positive come the first ``negatives`` rows of other labels
    whose score is from ``percent`` hundredths of the positive's score up to that score. A positive with a
    negative score has none.

    Rows with a null id, label or vector, or a null, non-finite or immense (over 1e140) component take no part;
    of rows that repeat an id the smallest by label, then vector counts. Shorter vectors are filled with zeros; an
    empty vector scores 0 with all. Scores beyond a long are cut to it. An empty table, or one
    without anchors, gives no rows. ``is_anchor`` and ``label`` are columns of ``vectors``; other columns, whatever
    their names, are not read.
    """
    spark = vectors.sparkSession
    own = F.col(label_col) if label is None else label
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), own.cast("bigint").alias("label"), F.col(vector_col).cast("array<double>").alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    sound = F.forall("x", lambda v: F.coalesce(F.abs(v) <= LARGEST, F.lit(False)))
    rows = rows.filter("id is not null and label is not null and x is not null").filter(sound)
    one = rows.groupBy("id").agg(F.min(F.struct("label", "x", "anchor")).alias("row"))
    rows = materialize(one.select("id", "row.*"), "negatives-rows")
    width, total = rows.agg(F.coalesce(F.max(F.size("x")), F.lit(0)), F.coalesce(F.sum(F.size("x")), F.lit(0))).first()
    shards = partitions_for(total, SHARD_COMPONENTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    home = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    anchors = rows.filter("anchor").select("id", "label", "x")
    none = F.array().cast("array<struct<id:bigint,score:bigint>>").alias("positives")
    settings = (shards, max(1, width), scale, max(positives, negatives) + 1)

    pilot = _probe(rows, anchors.select("id", "label", "x", F.lit(None).cast("bigint").alias("floor"), none, home), *settings, positives, None)
    floors = pilot.groupBy(F.col("anchor_id").alias("id")).agg(F.when(F.count(F.lit(1)) >= positives, F.min("score")).alias("floor"))
    asking = materialize(anchors.join(floors, "id", "left"), "negatives-anchors")
    near = _probe(rows, asking.select("id", "label", "x", "floor", none, every), *settings, positives, None)
    chosen = materialize(_first(near, ["anchor_id"], positives).select("anchor_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")).filter("positive_score >= 0"), "negatives-positives")

    least = F.ceil(F.col("positive_score").cast("decimal(20,0)") * F.lit(Decimal(percent) / 100)).cast("bigint")
    grouped = chosen.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score")))).alias("positives"), F.min(least).alias("floor"))
    asking = materialize(anchors.join(grouped, "id"), "negatives-asking")
    pilot = _probe(rows, asking.select("id", "label", "x", "floor", "positives", home), *settings, negatives, percent)
    seen = pilot.groupBy("anchor_id", "positive_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"))
    floors = chosen.join(seen, ["anchor_id", "positive_id"], "left").groupBy(F.col("anchor_id").alias("id")).agg(F.min(F.when(F.col("n") >= negatives, F.col("low")).otherwise(least)).alias("floor"))
    final = asking.drop("floor").join(floors, "id")
    hard = _probe(rows, final.select("id", "label", "x", "floor", "positives", every), *settings, negatives, percent)
    ranked = _first(hard, ["anchor_id", "positive_id"], negatives)
    return ranked.join(chosen, ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
