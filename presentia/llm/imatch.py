"""I-Match document fingerprints over randomised subsets of a corpus lexicon.

Terms whose document frequency lies in a band form the lexicon. A text keeps its distinct lexicon terms
in lexicon order; each of several randomised subsets of the lexicon picks some of them, and the picked
sequence is hashed. Texts that share a subset's hash agree on all their terms in that subset. Subsets come
in rungs, each a quarter as dense as the one before, and a fingerprint holds the two rungs at which its
text has about one term in a subset: short and long texts then lose about the same part of their
hashes to the same share of edits.

Scale. The lower end of the band is a share of all documents, so the lexicon has at most (mean distinct
terms of a document) / share terms however large the corpus is: that is what bounds the broadcast.
Document frequencies are summed in the tasks first and then by term. The neighbour in doc_id order comes
from one range shuffle in which each task sees its documents in order; only the edges of the ranges, one
row for each, are joined to the next range.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presentia.llm.arrow_text import bounded
from presentia.plans.materialize import materialize

SUBSETS = 40
#: First byte of the fingerprint of a text without lexicon terms.
NO_TERMS = 255
#: Share of documents with a term: the band of the lexicon.
LEAST_SHARE, MOST_SHARE = 0.001, 0.2
#: The bytes a lexicon may take in a worker, and what a term takes besides its own.
LEXICON_BYTES, TERM_BYTES = 512 << 20, 100
#: Distinct terms a task counts before it passes its counts on.
COUNTER_SIZE = 300_000

FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
MIX, STEP = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)


def terms(text: bytes) -> set[bytes]:
    """The distinct lower-cased words of letters and digits."""
    return set(text.translate(FOLD).split())


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """term binary, n: in how many documents each term occurs, over all documents."""

    def emit(seen: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for b in bounded(batches, "text", 4 << 20):
            for t in b.column("text").to_pylist():
                seen.update(terms(t))
                if len(seen) > COUNTER_SIZE:
                    yield emit(seen)
                    seen.clear()
        yield emit(seen)

    return docs.selectExpr(f"`{text_col}` as text").mapInArrow(run, "term binary, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, text_col: str = "text") -> list[bytes]:
    """The terms in the band, sorted. Terms of a single document are left out, they never match."""
    total = docs.count()
    low, high = max(2.0, LEAST_SHARE * total), max(2.0, MOST_SHARE * total)
    # Written before it is read: the counts' shuffle files go with the step.
    found = materialize(document_frequencies(docs, text_col).filter(F.col("n").between(low, high)).select("term"), "imatch-lexicon")
    size = found.agg(F.sum(F.octet_length("term") + TERM_BYTES)).first()[0] or 0
    if size > LEXICON_BYTES:  # only where documents have millions of distinct terms on average
        raise ValueError(f"a lexicon of {size} bytes is no broadcast; raise LEAST_SHARE")
    return sorted(bytes(r.term) for r in found.collect())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


class Fingerprinter:
    """Fingerprints by a lexicon."""

    def __init__(self, words: list[bytes]):
        self.number = {w: k for k, w in enumerate(words)}
        self.hashes = np.array([int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in words], np.uint64)
        self.seeds = _mixed(np.arange(1, SUBSETS + 1, dtype=np.uint64) * STEP)

    def _rung(self, own: np.ndarray, rung: int) -> bytes:
        """The 16-bit hashes of all subsets at a rung; zeros where a subset has none of the terms."""
        picked = (_mixed(own[None, :] ^ self.seeds[:, None]) >> np.uint64(64 - 2 * rung)) == 0 if rung else np.ones((SUBSETS, len(own)), bool)
        place = np.cumsum(picked, axis=1).astype(np.uint64)
        total = np.where(picked, _mixed(own[None, :] + place * STEP), np.uint64(0)).sum(axis=1, dtype=np.uint64)
        out = (_mixed(total ^ self.seeds) >> np.uint64(48)) | np.uint64(1)
        out[~picked.any(axis=1)] = 0
        return out.astype("<u2").tobytes()

    def fingerprint(self, text: bytes) -> bytes:
        """The rung, its hashes and those of the next rung; a text without lexicon terms gets the hash of its terms."""
        found = terms(text)
        own = sorted(n for w in found if (n := self.number.get(w)) is not None)
        if not own:
            return bytes([NO_TERMS]) + hashlib.sha256(b" ".join(sorted(found))).digest()[:8]
        hashes = self.hashes[own]
        rung = ((len(own) - 1).bit_length() + 1) // 2  # the first at which a subset has one term or fewer on average
        return bytes([rung]) + self._rung(hashes, rung) + self._rung(hashes, rung + 1)


def likeness(a: bytes, b: bytes) -> float:
    """The share of the subsets, empty in not both, whose hashes agree; 0 to 1."""
    if a == b:
        return 1.0
    if NO_TERMS in (a[0], b[0]) or abs(a[0] - b[0]) > 1:
        return 0.0
    rung = max(a[0], b[0])
    u, v = (np.frombuffer(x, "<u2", SUBSETS, 1 + 2 * SUBSETS * (rung - x[0])) for x in (a, b))
    used = (u | v) != 0
    return float((u == v)[used].mean()) if used.any() else 0.0


@functools.lru_cache(maxsize=1)
def _fingerprinter(key: str, words: tuple[bytes, ...]) -> Fingerprinter:
    return Fingerprinter(list(words))


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter of code points replaced by as many first ones of ``following``, or all."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


#: Digests and fingerprints are kept as bytes until the result is read.
FIELDS = "doc_id bigint, n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
NAMES = [c.split()[0] for c in FIELDS.split(", ")]
TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]


def _row(fp: Fingerprinter, doc_id, text: str, own: bytes, following: str, next_fp: bytes) -> tuple:
    new = edited(text, following).encode("utf-8", "replace")
    new_fp = fp.fingerprint(new)
    return doc_id, len(text), hashlib.sha256(new).digest(), own, new_fp, likeness(own, new_fp), likeness(own, next_fp)


def imatch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they are.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The
    next document is the next in (doc_id, text) order, null ids first; after the last comes the first, and
    a single document follows itself. Null texts count as empty. Equal texts have equal fingerprints; two
    empty texts are alike (1). Very long texts are read whole; repeated rows follow each other. An empty table
    gives an empty result. Other columns, whatever their names, are not read.
    """
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = docs.sparkSession.sparkContext.broadcast(tuple(lexicon(src)))
    key = hashlib.sha256(b"\0".join(words.value)).hexdigest()

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp = _fingerprinter(key, words.value)
        part = TaskContext.get().partitionId()
        held = None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            types = [*TYPES, pa.string(), pa.int32(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[*NAMES, "kind", "part", "text"])

        for b in bounded(batches, "text", 4 << 20):
            rows = []
            for doc_id, raw in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                text, own = raw.decode("utf-8", "replace"), fp.fingerprint(raw)
                if held is None:
                    rows.append((doc_id, len(text), None, own, None, None, None, "first", part, text))
                else:
                    rows.append((*_row(fp, *held, text, own), "row", None, None))
                held = (doc_id, text, own)
            if rows:
                yield batch(rows)
        if held is not None:
            doc_id, text, own = held
            yield batch([(doc_id, len(text), None, own, None, None, None, "last", part, text)])

    ordered = src.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    done = materialize(ordered.mapInArrow(in_order, f"{FIELDS}, kind string, part int, text string"), "imatch")

    firsts = done.filter("kind = 'first'")
    by_part = Window.orderBy("part")  # one row for each range, without texts
    after = firsts.select("part", F.lead("part").over(by_part).alias("to"), F.first("part").over(by_part).alias("start"))
    after = after.select("part", F.coalesce("to", "start").alias("to"))
    edges = (
        done.filter("kind = 'last'").select("part", "doc_id", "text", "fingerprint").join(after, "part")
        .join(firsts.select(F.col("part").alias("to"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fp")), "to")
        .select("doc_id", "text", "fingerprint", "next_text", "next_fp")
    )

    def at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                fp = _fingerprinter(key, words.value)
                rows = [_row(fp, *r) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=NAMES)

    out = done.filter("kind = 'row'").select(*NAMES).unionByName(edges.mapInArrow(at_edges, FIELDS))
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})
