"""Toxicity by compression distance: separate zstandard dictionaries of toxic and of ordinary text.

The dictionaries of a pair are trained by zstandard with the same size and parameters on equally many texts. A
window of text is compressed with each; a window that comes out shorter with the toxic one speaks toxic
language. Toxic documents consist mostly of ordinary language, and what zstandard finds most frequent in them
would be that. So the texts of a class are first reduced to its *own* words, and pairs of words that recur,
whose rate is ``CONTRAST`` times that in the other class. Behind both dictionaries of a pair stands the content of a third, trained on whole
ordinary texts: ordinary language then costs about the same with both, and the difference of the lengths is
evidence instead of noise. What zstandard picks depends on the order of its samples; several pairs, each
trained in an order of its own (by a keyed hash of the text), are averaged.

Training reads whole texts of a bounded sample of labelled rows (``max_toxic`` and ``max_ordinary`` rows chosen
by a hash of the id), one task for each pair; only the dictionaries, some kilobytes, reach the driver. The
threshold is calibrated on all labelled rows outside the held-out fold: rows of each fold are scored whole, on
executors, with dictionaries trained without that fold, and counts by rounded evidence reach the driver.
Neither the order nor the partitions of the rows change the model. Scoring reads every whole text window by
window, in one pass without a shuffle.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presentia.llm.arrow_text import bounded, slices
from presentia.llm.shingles import gram_hashes, word_hashes
from presentia.plans.materialize import materialize

#: Letters A-Z in lower case; every byte that is neither digit, letter nor part of a longer character becomes a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
FOLDS = 5
#: How many times its rate in the other class a word must have to be a class's own; the share of the class's
#: documents (three at least) that must have a pair of words in common for the pair to count like a word.
CONTRAST, PAIR_SHARE = 20, 0.05
#: Bytes of a class's dictionary, of the ordinary content behind both, and of a training sample.
OWN_BYTES, BASE_BYTES, OWN_PIECE, BASE_PIECE = 1024, 16384, 64, 256
#: Pairs of dictionaries.
PAIRS = 2
#: What a window must exceed to count in the mean, the windows added to it, and its weight beside the largest ones.
MARGIN, MEAN_PRIOR, MEAN_WEIGHT = 0.5, 10, 20.0
#: Bytes of a label in a broadcast, and of the labels that are broadcast.
LABEL_BYTES, BROADCAST_BYTES = 64, 64 << 20
#: Evidence is rounded to this part of a byte, so that few distinct values are counted.
GRAIN = 20


@dataclass(frozen=True)
class ToxicityModel:
    """What scoring needs: the first pair (``ordinary`` stands behind ``clean`` and ``toxic``), the threshold, and the contents of further pairs."""

    ordinary: bytes
    toxic: bytes
    threshold: float
    clean: bytes = b""
    further: tuple[tuple[bytes, bytes], ...] = ()
    window: int = 64
    level: int = 12

    @property
    def trained(self) -> bool:
        return bool(self.toxic)


@functools.lru_cache(maxsize=FOLDS + 1)
def _compressors(model: ToxicityModel) -> list[tuple]:
    def make(content: bytes):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=model.level)
        return zstandard.ZstdCompressor(level=model.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).multi_compress_to_buffer

    return [(make(a), make(b)) for a, b in ((model.clean + model.ordinary, model.toxic + model.ordinary), *model.further)]


def _pair_evidence(found: list[int]) -> float:
    """The mean of the two largest differences, less in texts of many windows, which have more chances, and the mean of all beyond the margin."""
    top = sorted(found)[-2:]
    top = sum(x for x in top if x > 0) / 2 / (1 + math.log(len(found)) / 4)
    return top + MEAN_WEIGHT * sum(x - MARGIN for x in found if x > MARGIN) / (len(found) + MEAN_PRIOR)


def evidences(texts: list[bytes], model: ToxicityModel) -> list[float]:
    """How much shorter the windows of each folded text are with the toxic dictionaries, in rounded bytes: the mean of all pairs.

    A dictionary compresses the windows of all texts in one call.
    """
    w = model.window
    index: dict[bytes, int] = {}  # windows that repeat are compressed once
    # The last window is as long as the others: what is short hardly compresses with any dictionary.
    places = [[index.setdefault(p or b" ", len(index)) for p in (*(t[i : i + w] for i in range(0, len(t) - w, w)), t[-w:])] for t in texts]
    pieces = list(index)
    total = [0.0] * len(texts)
    for ordinary, toxic in _compressors(model):
        gain = [len(x) - len(y) for x, y in zip(ordinary(pieces), toxic(pieces), strict=True)] if pieces else []
        for k, own in enumerate(places):
            total[k] += _pair_evidence([gain[i] for i in own])
    n = len(_compressors(model))
    return [round(x / n * GRAIN) / GRAIN for x in total]


def evidence(text: bytes, model: ToxicityModel) -> float:
    """:func:`evidences` of one text."""
    return evidences([text], model)[0]


def score_of(value: float, model: ToxicityModel) -> float:
    """0 to 1, 0.5 at the threshold."""
    return 1.0 / (1.0 + math.exp(min(60.0, model.threshold - value))) if model.trained else 0.0


def _dictionary(pieces: list[bytes], n_bytes: int, **parameters: int) -> bytes:
    """What zstandard finds worth keeping of all pieces."""
    pieces = [p for p in pieces if len(p) >= 8]
    try:
        return zstandard.train_dictionary(n_bytes, pieces, level=6, **parameters).as_bytes()
    except zstandard.ZstdError:  # too little text for a dictionary of its own: the text itself serves
        return b" ".join(pieces)[-n_bytes:]


def _cut(text: bytes, size: int) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)]


@dataclass(frozen=True)
class _Text:
    """A training text, its fold, the hashes of its words in order, and its distinct hashes of words and of pairs of words."""

    text: bytes
    fold: int
    words: np.ndarray
    distinct: np.ndarray
    pairs: np.ndarray

    @classmethod
    def of(cls, text: bytes, fold: int) -> _Text:
        words = word_hashes(text, np.array([0, len(text)]))[0]
        return cls(text, fold, words, np.unique(words), np.unique(gram_hashes(words, 2)))


def _telling(own: list[np.ndarray], other: list[np.ndarray], least: float) -> np.ndarray:
    """The hashes in at least so many of the own sets whose rate is ``CONTRAST`` times that in the others, sorted."""
    keys, n = np.unique(np.concatenate(own), return_counts=True)
    names, counts = np.unique(np.concatenate([*other, np.full(1, np.iinfo(np.uint64).max, np.uint64)]), return_counts=True)
    at = np.searchsorted(names, keys)
    m = np.where(names[at] == keys, counts[at], 0)
    return keys[(n >= least) & (n * len(other) > CONTRAST * m * len(own))]


def _among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which values are among the sorted keys."""
    if not len(keys):
        return np.zeros(len(values), bool)
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values


def _own_pieces(texts: list[_Text], own: list[_Text], other: list[_Text]) -> list[bytes]:
    """The words, and runs of pairs of words, of each text that its class has and the other hardly has, in pieces."""
    words = _telling([t.distinct for t in own], [t.distinct for t in other], 1)
    pairs = _telling([t.pairs for t in own], [t.pairs for t in other], max(3, PAIR_SHARE * len(own)))
    out = []
    for t in texts:
        names = t.text.split()
        kept = {names[k] for k in np.flatnonzero(_among(t.words, words)).tolist()}
        if len(pairs) and len(names) > 1:
            hit = _among(gram_hashes(t.words, 2), pairs)
            bounds = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).tolist()
            kept |= {b" ".join(names[a : b + 1]) for a, b in zip(bounds[::2], bounds[1::2], strict=True)}
        if kept:
            out += _cut(b"  " + b"  ".join(sorted(kept)) + b"  ", OWN_PIECE)
    return out


def dictionaries(rows: Iterable[tuple[bool, int, bytes]], seed: int) -> dict[int, tuple[bytes, bytes, bytes]]:
    """The common content, the ordinary and the toxic dictionary, without each fold (-1: of all rows).

    ``rows``: (toxic, fold, folded text); repeats count once and their order is of no account, that of ``seed`` is.
    """
    key = seed.to_bytes(4, "little")
    distinct = sorted(set(rows), key=lambda r: (hashlib.blake2b(r[2], key=key).digest(), r[0], r[1]))
    base = _dictionary([p for toxic, _, t in distinct if not toxic for p in _cut(t, BASE_PIECE)], BASE_BYTES, k=64, d=8)
    hostile, ordinary = ([_Text.of(t, fold) for toxic, fold, t in distinct if toxic is k] for k in (True, False))
    found = {}
    for fold in (-1, *sorted({t.fold for t in (*hostile, *ordinary)})):
        bad, good = ([t for t in texts if t.fold != fold] for texts in (hostile, ordinary))
        if any(len(t.words) for t in bad) and any(len(t.words) for t in good):
            pieces = _own_pieces(good[: len(bad)], good, bad), _own_pieces(bad, bad, good)
            trained = [_dictionary(p, OWN_BYTES, k=8, d=8) for p in pieces]
            found[fold] = base, trained[0], trained[1] or b" "
    return found


def train(docs: DataFrame, labels: DataFrame, held_out_fold: int = 0, max_toxic: int = 1500, max_ordinary: int = 4000, clean_weight: float = 2.0) -> ToxicityModel:
    """A model from the labelled rows outside the held-out fold (crc32 of the id as text, modulo 5).

    At most ``max_toxic`` and ``max_ordinary`` of them, whole texts, train the dictionaries; all of them set the
    threshold. ``clean_weight`` is what sparing a clean document counts against catching a toxic one. Without
    rows of both classes the model is untrained and scores 0. Null labels and ids are ignored; null texts
    count as empty; a doc_id with several labels is toxic if one of them says so; equal texts train once.
    """
    fold = (F.crc32(F.col("doc_id").cast("string")) % FOLDS).cast("int")
    lab = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    # Written: two plans read it, and its true size decides whether texts are shuffled to it.
    lab = materialize(lab.select("doc_id", "toxic", fold.alias("fold")).filter(F.col("fold") != held_out_fold), "toxic-labels")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = lab.filter("toxic").orderBy(*order).limit(max_toxic).unionByName(lab.filter("not toxic").orderBy(*order).limit(max_ordinary))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def learn(table: pa.Table) -> pa.Table:
        rows = {
            (k, f, t.translate(FOLD))
            for b in bounded(table.to_batches(), "text", 4 << 20)
            for k, f, t in zip(b.column("toxic").to_pylist(), b.column("fold").to_pylist(), b.column("text").to_pylist(), strict=True)
        }
        pair = table.column("pair")[0].as_py()
        found = dictionaries(rows, pair)
        del rows
        pa.default_memory_pool().release_unused()  # the worker lives on
        cols = [[pair] * len(found), list(found), *(list(c) for c in zip(*found.values(), strict=True))] if found else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), *[pa.binary()] * 3), strict=True)], names=["pair", "fold", "base", "clean", "toxic"])

    # A task sees the sample, which max_toxic and max_ordinary bound, once for each pair.
    sample = texts.join(F.broadcast(chosen), "doc_id").select(F.explode(F.array(*map(F.lit, range(PAIRS)))).alias("pair"), "toxic", "fold", "text")
    learned = sample.groupBy("pair").applyInArrow(learn, "pair int, fold int, base binary, clean binary, toxic binary").collect()
    models: dict[int, ToxicityModel] = {}
    for f in {r.fold for r in learned}:
        contents = [(bytes(r.clean), bytes(r.toxic), bytes(r.base)) for r in sorted(learned, key=lambda r: r.pair) if r.fold == f]
        (clean, toxic, base), *others = contents
        models[f] = ToxicityModel(base, toxic, 1.0, clean, tuple((c + b, t + b) for c, t, b in others))
    if -1 not in models:
        return ToxicityModel(b"", b"", 0.0)
    # Labels that are few by their count go to the texts; many meet them in a shuffle.
    few = lab.count() * LABEL_BYTES <= BROADCAST_BYTES
    counted = _evidences(texts.join(F.broadcast(lab) if few else lab, "doc_id"), models).groupBy("toxic", "evidence").agg(F.count(F.lit(1)).alias("n")).collect()
    hit, miss = (np.sort(np.repeat([r.evidence for r in counted if r.toxic is k], [r.n for r in counted if r.toxic is k])) for k in (True, False))
    values = np.unique(np.concatenate([hit, miss]))
    cuts = np.append((values[1:] + values[:-1]) / 2, values[-1:] + 1 / GRAIN)
    gain = [(1 - np.searchsorted(hit, c) / max(1, len(hit))) + clean_weight * np.searchsorted(miss, c) / max(1, len(miss)) for c in cuts]
    return replace(models[-1], threshold=float(cuts[int(np.argmax(gain))]))


def _evidences(docs: DataFrame, models: dict[int, ToxicityModel]) -> DataFrame:
    """toxic, evidence of whole texts, each with the model that has not seen its fold; some kilobytes go with the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "text", 4 << 20):
            folds = b.column("fold").to_pylist()
            for f in sorted(set(folds)):
                part = b.filter(pa.array([x == f for x in folds], pa.bool_()))
                values = evidences([t.translate(FOLD) for t in part.column("text").to_pylist()], models.get(f, models[-1]))
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(values, pa.float64())], names=["toxic", "evidence"])

    return docs.select("toxic", "fold", "text").mapInArrow(run, "toxic boolean, evidence double")


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score double (0 to 1), predicted int for every row.

    Null and empty texts have no window with evidence and get the score of zero evidence. Very long texts are
    read to their end. Equal texts get equal scores, so there are no ties to break; repeated rows are scored as
    often as they occur; an empty table gives none. Further columns, whatever their names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "text", 4 << 20):
            texts = [t.translate(FOLD) for t in b.column("text").to_pylist()]
            s = [score_of(e, model) for e in evidences(texts, model)] if model.trained else [0.0] * len(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names=["doc_id", "score", "predicted"]
            )

    src = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text")
    return src.mapInArrow(run, "doc_id bigint, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text is not predicted toxic.

    Narrow: rows stay where they are. Null and empty texts have no evidence and stay, unless the threshold is
    zero; very long texts are read whole; repeated rows stay or go together; an empty table stays empty; columns
    of any names pass unread.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col, 4 << 20):
            texts = [(t.as_py() or "").encode().translate(FOLD) for t in b.column(b.schema.get_field_index(text_col))]
            yield b.filter(pa.array([score_of(e, model) < 0.5 for e in evidences(texts, model)] if model.trained else [True] * len(texts), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
