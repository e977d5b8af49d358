"""Token ids in files of fixed-width bit fields.

A file starts with its width (the least bits that hold every id of the vocabulary) and block length, then
come the blocks: each packs so many ids without gaps and starts at a byte. The footer has the offset of
every block and a table of the documents, ids and where each starts, so any range of ids is read by
unpacking the blocks that hold it, in one numpy call, without reading the rest.

Rows are put in order of doc_id by a range shuffle, encoded behind it and written as they come; a task
holds about a megabyte of text and a few blocks. A file's name has the task attempt in it and the index
lists the files of the attempts that ended well, so a repeated task never overwrites what is referred to,
and what a failed one left is deleted once the index is written.

Encoding is the tokenizers library's. Its byte-level pre-tokenizer cuts texts at places that depend only
on the classes of characters; where a vocabulary uses it, texts are cut in numpy (the library is asked for
the class of each new character), and each distinct slice is encoded by the library once for a worker.
"""

from __future__ import annotations

import functools
import json
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from presentia.llm.arrow_text import bounded
from presentia.llm.bpe import token_starts
from presentia.plans.materialize import materialize, scratch_path

MAGIC = b"IDBLOCKS"
HEAD = struct.Struct("<8sII")  # magic, bits of an id, ids of a block
TAIL = struct.Struct("<QQQQ8s")  # ids, blocks, documents, where the footer starts, magic
#: Ids of a block, a multiple of 8 so that a block ends at a byte.
BLOCK_IDS = 4096
#: Ids after which a task starts its next file.
FILE_IDS = 1 << 26
#: Ids that are packed or unpacked at a time.
CHUNK_IDS = 1 << 18
#: Slices a worker remembers before it starts anew, and the longest that it remembers, in bytes.
CACHE_SIZE, CACHED_BYTES = 150_000, 64
#: What stands for a class of characters: letter, number, other, white space.
LETTER, NUMBER, OTHER, SPACE = ord("b"), ord("1"), ord("!"), ord("\t")
_UNKNOWN = 0xFFFFFFFF
INDEX_SCHEMA = "part int, seq int, file string, documents bigint, ids bigint"


def bits_for(vocabulary: int) -> int:
    """The least bits that hold the ids 0 to vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as bit fields, lowest bit first, padded to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    fields = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(fields.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of packed ``data``."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    fields = np.zeros((n, 32), np.uint8)
    fields[:, :bits] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return np.packbits(fields, axis=1, bitorder="little").view("<u4").ravel()


class IdFileWriter:
    """One file: blocks as their ids come, then the footer."""

    def __init__(self, filesystem: fs.FileSystem, path: str, bits: int, block: int = BLOCK_IDS):
        if block % 8:
            raise ValueError("a block holds a multiple of 8 ids")
        self._out = filesystem.open_output_stream(path, compression=None)
        self._out.write(HEAD.pack(MAGIC, bits, block))
        self.bits, self.block, self.ids = bits, block, 0
        self._pending: list[np.ndarray] = []
        self._waiting, self._at, self._offsets = 0, HEAD.size, []
        self.documents: list[int | None] = []
        self._starts: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.documents.append(doc_id)
        self._starts.append(self.ids)
        self._pending.append(ids)
        self.ids, self._waiting = self.ids + len(ids), self._waiting + len(ids)
        if self._waiting >= CHUNK_IDS:
            self._write(False)

    def _write(self, last: bool) -> None:
        ids = np.concatenate(self._pending) if self._pending else np.zeros(0, "<u4")
        end = len(ids) if last else len(ids) // self.block * self.block
        for a in range(0, end, self.block):
            self._offsets.append(self._at)
            self._at += -(-min(self.block, end - a) * self.bits // 8)
        step = max(self.block, CHUNK_IDS // self.block * self.block)
        for a in range(0, end, step):
            self._out.write(pack(ids[a : min(end, a + step)], self.bits))
        self._pending, self._waiting = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._write(True)
        known = np.array([d is not None for d in self.documents], np.uint8)
        named = np.array([d or 0 for d in self.documents], "<i8")
        self._out.write(np.array(self._offsets, "<u8").tobytes() + known.tobytes() + named.tobytes() + np.array(self._starts, "<u8").tobytes())
        self._out.write(TAIL.pack(self.ids, len(self._offsets), len(self.documents), self._at, MAGIC))
        self._out.close()


class IdFileReader:
    """Random access to the ids and documents of a file."""

    def __init__(self, filesystem: fs.FileSystem, path: str):
        self._file = filesystem.open_input_file(path)
        magic, self.bits, self.block = HEAD.unpack(self._file.read(HEAD.size))
        self._file.seek(self._file.size() - TAIL.size)
        self.ids, blocks, documents, at, end_magic = TAIL.unpack(self._file.read(TAIL.size))
        if magic != MAGIC or end_magic != MAGIC:
            raise ValueError(f"{path} is not a whole file of packed ids")
        self._file.seek(at)
        self._offsets = np.append(np.frombuffer(self._file.read(8 * blocks), "<u8"), np.uint64(at)).tolist()
        known = np.frombuffer(self._file.read(documents), np.uint8).tolist()
        named = np.frombuffer(self._file.read(8 * documents), "<i8").tolist()
        self.documents = [d if k else None for d, k in zip(named, known, strict=True)]
        self.starts = [*np.frombuffer(self._file.read(8 * documents), "<u8").tolist(), self.ids]

    def read(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to before ``stop``: the blocks that hold them, unpacked at once."""
        stop = min(stop, self.ids)
        if start >= stop:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        self._file.seek(self._offsets[first])
        data = self._file.read(self._offsets[last + 1] - self._offsets[first])
        return unpack(data, self.bits, min(self.ids, (last + 1) * self.block) - first * self.block)[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        return self.read(self.starts[k], self.starts[k + 1])

    def pieces(self) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(document, some of its ids, whether they are its last) in order, from chunks of bounded size."""
        base, held = 0, np.zeros(0, "<u4")
        for k in range(len(self.documents)):
            at, stop = self.starts[k], self.starts[k + 1]
            while True:
                if at >= base + len(held) and at < stop:
                    base, held = at, self.read(at, at + CHUNK_IDS)
                to = min(stop, base + len(held))
                yield k, held[at - base : to - base], to >= stop
                at = to
                if at >= stop:
                    break

    def close(self) -> None:
        self._file.close()


class _Slices(dict):
    """slice -> its ids as unsigned 32-bit integers; the library's model merges it on a miss."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self._merge = tokenizer.model.tokenize
        # The model takes a character for each byte; which one, the library's pre-tokenizer shows.
        self._letters: dict[int, str] = {}
        for cp in (*range(0x800), *range(0x800, 0x10000, 0x800), *range(0x10000, 0x110000, 0x10000)):
            if not 0xD800 <= cp < 0xE000:
                shown = "".join(part for part, _ in tokenizer.pre_tokenizer.pre_tokenize_str(chr(cp)))
                self._letters |= dict(zip(chr(cp).encode(), shown, strict=True))

    def __missing__(self, piece: bytes) -> bytes:
        out = array("I", [t.id for t in self._merge(piece.decode("latin-1").translate(self._letters))]).tobytes()
        if len(piece) <= CACHED_BYTES:
            if len(self) >= CACHE_SIZE:
                self.clear()
            self[piece] = out
        return out


class Encoder:
    """Ids of texts by a vocabulary of the tokenizers library, without special tokens around them."""

    def __init__(self, config: str):
        self.tokenizer = Tokenizer.from_str(config)
        self.vocabulary = max(self.tokenizer.get_vocab().values()) + 1
        self._marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        said = json.loads(config)
        cutter = said["pre_tokenizer"] or {}
        plain = said["normalizer"] is None and said["post_processor"] is None and said["truncation"] is None and said["padding"] is None
        self.sliced = plain and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space", True)
        self._slices = _Slices(self.tokenizer) if self.sliced else {}
        self._stands_for = np.full(0x110000, _UNKNOWN, np.uint32)
        self._stands_for[:128] = np.arange(128)

    def _classes(self, cps: np.ndarray) -> np.ndarray:
        """Each character, or one of its class beyond ASCII, as the library's own cuts tell."""
        out = self._stands_for[cps]
        if (new := out == _UNKNOWN).any():
            cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
            for cp in np.unique(cps[new]).tolist():
                alike = (k for k in (LETTER, NUMBER, OTHER) if len(cut(chr(k) + chr(cp) + chr(k))) == 1)
                self._stands_for[cp] = next(alike, SPACE)
            out = self._stands_for[cps]
        return out

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each UTF-8 text."""
        strings = [t.decode("utf-8", "replace") for t in texts]
        if not self.sliced:
            return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
        whole_ones = {k: np.array(self.tokenizer.encode(s, add_special_tokens=False).ids, "<u4") for k, s in enumerate(strings) if any(m in s for m in self._marks)}
        strings = ["" if k in whole_ones else s for k, s in enumerate(strings)]
        joined = "".join(strings)
        if not joined:
            return [whole_ones.get(k, np.zeros(0, "<u4")) for k in range(len(texts))]
        cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lengths = np.array([len(s) for s in strings], np.int64)
        at = np.concatenate(([0], np.cumsum(lengths)))
        starts = np.flatnonzero(token_starts(self._classes(cps), at[:-1][lengths > 0]))
        byte = np.concatenate(([0], np.cumsum(1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000))))
        whole, cut, slices = joined.encode(), np.append(byte[starts], byte[-1]).tolist(), self._slices
        packed = [slices[whole[a:b]] for a, b in zip(cut, cut[1:], strict=False)]
        first = np.searchsorted(starts, at).tolist()
        return [whole_ones[k] if k in whole_ones else np.frombuffer(b"".join(packed[first[k] : first[k + 1]]), "<u4") for k in range(len(texts))]


@functools.lru_cache(maxsize=2)
def encoder(config: str) -> Encoder:
    """One for each worker process."""
    return Encoder(config)


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK_IDS, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the ids of all texts, each followed by ``end_id``, below ``path`` and returns the index of the files.

    ``path`` is a URI that all executors reach. Documents stand in ascending order of their ids, rows that repeat an
    id in order of a hash of their text, then of the text; a null id comes first. Null and empty texts have the end id
    only; very long texts are encoded whole. An empty table gives an empty index. Other columns, whatever their names,
    are not read.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        held = spark.sparkContext.broadcast(f.read())  # a vocabulary, of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = fs.FileSystem.from_uri(path)
        filesystem.create_dir(root, recursive=True)
        own, context = encoder(held.value), TaskContext.get()
        bits = bits_for(max(own.vocabulary, (end_id or 0) + 1))
        end = np.array([] if end_id is None else [end_id], "<u4")
        made, out, name = [], None, ""
        for b in bounded(batches, "text"):
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), own.encode(b.column("text").to_pylist()), strict=True):
                if out is None:
                    name = f"ids-{context.partitionId():06d}-{context.taskAttemptId()}-{len(made)}.bin"
                    out = IdFileWriter(filesystem, f"{root}/{name}", bits, block)
                out.add(doc_id, np.concatenate([ids, end]))
                if out.ids >= file_ids:
                    out.close()
                    made.append((name, len(out.documents), out.ids))
                    out = None
        if out is not None:
            out.close()
            made.append((name, len(out.documents), out.ids))
        if made:
            names, documents, ids = zip(*made, strict=True)
            part = [context.partitionId()] * len(made)
            cols = [pa.array(part, pa.int32()), pa.array(range(len(made)), pa.int32()), pa.array(names), pa.array(documents, pa.int64()), pa.array(ids, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["part", "seq", "file", "documents", "ids"])

    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = src.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")
    index = materialize(ordered.mapInArrow(run, INDEX_SCHEMA), "token-index")
    held.destroy()
    sweep(index, path)
    return index


def sweep(index: DataFrame, path: str) -> None:
    """Deletes what failed or repeated attempts left: the files below ``path`` that the index does not list."""
    filesystem, root = fs.FileSystem.from_uri(path)
    there = filesystem.get_file_info(fs.FileSelector(root, allow_not_found=True))
    if len(there) > index.count():
        listed = {f for (f,) in index.select("file").collect()}
        for info in there:
            if info.base_name.startswith("ids-") and info.base_name not in listed:
                filesystem.delete_file(info.path)


def read_token_files(index: DataFrame, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document in the files of ``index``.

    An empty index gives an empty result. Each file is a task's work; its chunks are unpacked one at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = fs.FileSystem.from_uri(path)
        for b in batches:
            for file, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True):
                reader = IdFileReader(filesystem, f"{root}/{file}")
                sums, crc = [], 0
                for _, ids, last in reader.pieces():
                    crc = zlib.crc32(ids.tobytes(), crc)
                    if last:
                        sums.append(crc)
                        crc = 0
                starts = np.array(reader.starts, np.int64)
                cols = [pa.array(reader.documents, pa.int64()), pa.array(starts[:-1] + start), pa.array(np.diff(starts)), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])
                reader.close()

    # One row for each 64 million ids: what comes before a file is summed over the list of files.
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = materialize(index.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start")), "token-places")
    return placed.repartition(max(1, placed.count())).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_round_trip(spark: SparkSession, docs: DataFrame, tokenizer_path: str, path: str | None = None, **options) -> DataFrame:
    """Writes all texts as packed ids and reads the files back: one row for each document, as the two functions say."""
    path = path or scratch_path(spark, "tokens")
    return read_token_files(write_token_files(docs, tokenizer_path, path, **options), path)
