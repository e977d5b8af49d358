"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding.

Where a text is split is found without a regular expression. Each code point gets a class (letter,
number, white space, other) from a table. What the pattern decides from a character's neighbours is
read from shifted class arrays; what it decides from the past (a contraction such as ``'re`` swallows
the letters after the apostrophe and then ends) is a small automaton. Its transition functions compose
associatively, so the state before every character comes from a blocked prefix scan of function
compositions. The resulting slices are looked up in a bounded cache that merges pairs on a miss.

Work is per document, without a shuffle. A task holds about a megabyte of text, or one longer text.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from presentia.llm.arrow_text import bounded

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: The code points with the White_Space property.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
#: Entries of the slice cache before it starts anew.
CACHE_SIZE = 200_000
#: Automaton states: nothing pending, one or two letters of a contraction to come, contraction just over.
IDLE, ONE_LEFT, TWO_LEFT, OVER = 0, 1, 2, 3


@functools.cache
def class_table() -> np.ndarray:
    """The class of every code point; the newest Unicode tables at hand are those of the regex package."""
    table = np.zeros(0x110000, np.uint8)
    points = [cp for cp in range(0x110000) if not 0xD800 <= cp < 0xE000]
    for name, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER)):
        table[[ord(ch) for ch in regex.findall(name, "".join(map(chr, points)))]] = kind
    table[WHITE_SPACE] = SPACE
    return table


def _packed(*to: int) -> int:
    """The function of four states as one byte, two bits for each state."""
    return sum(s << 2 * k for k, s in enumerate(to))


IDENTITY = _packed(0, 1, 2, 3)
#: What a character does to the state, by how many letters the contraction that starts at it would take.
STEP = np.array([_packed(0, 3, 1, 0), _packed(1, 3, 1, 1), _packed(2, 3, 1, 2)], np.uint8)
#: The same at the first character of a text, where the past is forgotten.
FIRST = np.array([_packed(k, k, k, k) for k in (0, 1, 2)], np.uint8)


@functools.cache
def composition_table() -> np.ndarray:
    """[f, g]: the function that applies f, then g."""
    f = np.arange(256)
    out = np.zeros((256, 256), np.uint8)
    for s in range(4):
        mid = (f >> 2 * s) & 3
        out |= (((f[None, :] >> (2 * mid[:, None])) & 3) << 2 * s).astype(np.uint8)
    return out


def scan(funcs: np.ndarray, width: int = 64) -> np.ndarray:
    """Inclusive prefix compositions of packed functions: by rows, over the rows' totals, then joined."""
    n = len(funcs)
    if n <= 1:
        return funcs
    comp = composition_table()
    rows = -(-n // width)
    m = np.full(rows * width, IDENTITY, np.uint8)
    m[:n] = funcs
    m = np.ascontiguousarray(m.reshape(rows, width).T)
    for j in range(1, width):
        m[j] = comp[m[j - 1], m[j]]
    if rows > 1:
        before = scan(m[-1], width)[:-1]
        m[:, 1:] = comp[before[None, :], m[:, 1:]]
    return m.T.reshape(-1)[:n]


def token_starts(cps: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Whether a slice starts at each code point; ``doc_starts`` are the texts' first positions."""
    n = len(cps)
    kind = class_table()[cps]
    first = np.zeros(n + 1, bool)
    first[doc_starts] = True
    last = first[1:].copy()  # of its text
    last[n - 1] = True
    first = first[:n]
    prev = np.empty(n, np.uint8)
    prev[0], prev[1:] = 255, kind[:-1]
    prev[first] = 255
    follows = np.empty(n, np.uint8)
    follows[-1], follows[:-1] = 255, kind[1:]
    follows[last] = 255
    after_blank = np.zeros(n, bool)
    after_blank[1:] = cps[:-1] == 32
    after_blank[first] = False

    takes = np.zeros(n, np.uint8)
    quotes = np.flatnonzero((cps == 39) & (prev != OTHER) & ~after_blank)
    if len(quotes):
        end = np.append(np.flatnonzero(first), n)
        stop = end[np.searchsorted(end, quotes, "right")]
        padded = np.append(cps, np.zeros(2, cps.dtype))
        a = np.where(quotes + 1 < stop, padded[quotes + 1], 0)
        b = np.where(quotes + 2 < stop, padded[np.minimum(quotes + 2, n)], 0)
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        takes[quotes] = np.where(one, 1, np.where(two, 2, 0))

    funcs = STEP[takes]
    funcs[first] = FIRST[takes[first]]
    state = np.zeros(n, np.uint8)  # before each character
    state[1:] = scan(funcs)[:-1] & 3
    state[first] = IDLE

    blank = kind == SPACE
    starts = np.where(blank, (prev != SPACE) | (follows != 255) & (follows != SPACE), (prev != kind) & ~after_blank)
    starts[(state == ONE_LEFT) | (state == TWO_LEFT)] = False
    starts[state == OVER] = True
    starts[first] = True
    return starts


class Merger(dict):
    """slice -> its ids as little-endian unsigned 32-bit integers; merges on a miss."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.vocabulary = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.vocabulary[rank] = token

    def __missing__(self, piece: bytes) -> bytes:
        rank = self.ranks.get(piece)
        ids = [rank] if rank is not None else (_merged if len(piece) <= 64 else _merged_long)(piece, self.ranks)
        out = np.array(ids, "<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= CACHE_SIZE:
                self.clear()
            self[piece] = out
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes that packed ids stand for."""
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merges the adjacent pair of lowest rank, leftmost first, until none has a rank."""
    none = 1 << 60
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pair = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while pair:
        low = min(pair)
        if low == none:
            break
        i = pair.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i:
            pair[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        if i < len(pair):
            pair[i] = ranks.get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


def _merged_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for long slices, by a heap of pairs over a linked list."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts here
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
            heap.append((r, i, j, end[j])) if building else heapq.heappush(heap, (r, i, j, end[j]))

    building = True
    for i in range(n - 1):
        offer(i)
    heapq.heapify(heap)
    building = False
    while heap:
        _, i, j, to = heapq.heappop(heap)
        if not (alive[i] and j < n and alive[j] and end[i] == j and end[j] == to):
            continue
        alive[j], end[i] = False, to
        if to < n:
            before[to] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


def read_ranks(path: str) -> bytes:
    """The rank file's content, read once on the driver; a vocabulary has a fixed size."""
    with open(path, "rb") as f:
        return f.read()


@functools.lru_cache(maxsize=2)
def merger(rank_file: bytes) -> Merger:
    """One cache for each worker process."""
    return Merger({base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)})


def encode_batch(texts: list[bytes], merge: Merger) -> tuple[list[list[bytes]], list[list[int]]]:
    """For each text, its slices' packed ids and the slices' byte offsets."""
    strings = [t.decode("utf-8", "replace") for t in texts]
    cps = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(s) for s in strings], np.int64)
    at = np.concatenate(([0], np.cumsum(lengths)))
    if not len(cps):
        return [[] for _ in texts], [[] for _ in texts]
    starts = np.flatnonzero(token_starts(cps, at[:-1][lengths > 0]))
    width = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
    byte = np.concatenate(([0], np.cumsum(width)))
    whole = b"".join(texts) if all(len(t) == b for t, b in zip(texts, np.diff(byte[at]).tolist(), strict=True)) else "".join(strings).encode()
    cut = np.append(byte[starts], byte[-1]).tolist()
    packed = [merge[whole[a:b]] for a, b in zip(cut, cut[1:], strict=False)]
    first = np.searchsorted(starts, at).tolist()
    ids = [packed[a:b] for a, b in zip(first, first[1:], strict=False)]
    offsets = [cut[a:b] for a, b in zip(first, first[1:], strict=False)]
    return ids, [[x - o for x in xs] for xs, o in zip(offsets, byte[at].tolist(), strict=False)]


def bpe_encode(docs: DataFrame, rank_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, slice_offsets array<long> (where in the UTF-8 text each slice starts), slice_ids array<int> (ids of each slice).

    Null and empty texts give empty arrays; very long texts are encoded whole; ids stay as they are, repeated rows
    are encoded as often as they occur; an empty table gives none. Other columns, whatever their names, are not read.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = merger(ranks.value)
        for b in bounded(batches, "text"):
            ids, offsets = encode_batch(b.column("text").to_pylist(), merge)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([np.frombuffer(b"".join(x), "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())),
                    pa.array(offsets, pa.list_(pa.int64())),
                    pa.array([[len(p) // 4 for p in x] for x in ids], pa.list_(pa.int32())),
                ],
                names=["doc_id", "ids", "slice_offsets", "slice_ids"],
            )

    src = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text")
    return src.mapInArrow(run, "doc_id bigint, ids array<int>, slice_offsets array<bigint>, slice_ids array<int>")


def bpe_decode(encoded: DataFrame, rank_path: str) -> DataFrame:
    """doc_id and the decoded text, as bytes, of the rows of :func:`bpe_encode`.

    Null and empty ids give empty bytes; repeated rows give repeated results, an empty table none; other columns
    are not read.
    """
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = merger(ranks.value)
        for b in batches:
            out = [merge.decode(np.array(x or [], "<u4").tobytes()) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, decoded binary")


def bpe_round_trip(docs: DataFrame, rank_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256.

    Each text is encoded and its ids are decoded again in one pass, so ids need not leave the task. Null
    counts as empty, very long texts are encoded whole. Repeated rows give repeated results; an empty table gives
    none. Other columns, whatever their names, are not read.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = merger(ranks.value)
        for b in bounded(batches, "text"):
            n, ids_sha, text_sha = [], [], []
            for parts in encode_batch(b.column("text").to_pylist(), merge)[0]:
                ids = b"".join(parts)
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(merge.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    src = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text")
    return src.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
