"""Entries of one large JSON object of path -> numbers, read in parallel.

The file is read as text cut at ``]``, which Spark splits by byte ranges on any file system. Whether a bracket
or comma at some place is part of a string, and how deep it stands, depends on all that stands before it; but
what a stretch of text does to that state is a function of three states (outside strings, inside one, behind a
backslash in one), and functions compose. A first pass makes the function of each block, the driver composes
them in order (a row for each block of the file), and a second pass cuts each block into entries from the
state it starts with. The ends of entries that blocks tear are put together by the block they start in.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presentia.plans.materialize import materialize

OUTSIDE, INSIDE, ESCAPED = range(3)
QUOTE, BACKSLASH, COMMA, OPEN, CLOSE = 34, 92, 44, (91, 123), (93, 125)
SEPARATOR = b"]"
MARK = "﻿"


def lexed(data: np.ndarray, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each byte whether it is in a string and whether it is a string's quote; and the state behind them."""
    at = np.arange(len(data))
    slash = data == BACKSLASH
    if state == ESCAPED or slash.any():
        last = np.maximum.accumulate(np.where(slash, -1, at)) if len(data) else at
        run = at - last + ((last < 0) & (state == ESCAPED))  # backslashes up to here; one may stand before the first byte
        run = np.where(slash, np.where(last < 0, at + 1 + (state == ESCAPED), run), 0)
        before = np.concatenate(([int(state == ESCAPED)], run[:-1])) if len(data) else run
        quote = (data == QUOTE) & (before % 2 == 0)
        open_end = bool(len(data) and run[-1] % 2) if len(data) else state == ESCAPED
    else:
        quote, open_end = data == QUOTE, False
    inside = ((np.cumsum(quote) + (state != OUTSIDE)) % 2).astype(bool)
    end = bool(inside[-1]) if len(data) else state != OUTSIDE
    return inside ^ quote, quote, (ESCAPED if open_end else INSIDE) if end else OUTSIDE


def depth_steps(data: np.ndarray, inside: np.ndarray, quote: np.ndarray) -> np.ndarray:
    """What each byte adds to the depth."""
    free = ~inside & ~quote
    return (np.isin(data, OPEN) & free).astype(np.int64) - (np.isin(data, CLOSE) & free)


def effects(data: bytes) -> list[tuple[int, int]]:
    """For each state before ``data`` the state behind it and what it adds to the depth."""
    text = np.frombuffer(data, np.uint8)
    out = []
    for state in (OUTSIDE, INSIDE, ESCAPED):
        inside, quote, end = lexed(text, state)
        out.append((end, int(depth_steps(text, inside, quote).sum())))
    return out


@dataclass
class Cutter:
    """Cuts text into the entries of an object; ``state`` and ``depth`` are those before it."""

    state: int = OUTSIDE
    depth: int = 0
    first: bool = True  # whether the text is the file's first
    carry: bytes = b""
    cut: bool = False  # whether an entry has begun or ended in this text

    def feed(self, data: bytes) -> Iterator[tuple[bool, bytes]]:
        """(whether it begins in this text, the entry between the signs before and behind it) for each entry that ends in ``data``."""
        text = np.frombuffer(data, np.uint8)
        inside, quote, state = lexed(text, self.state)
        step = depth_steps(text, inside, quote)
        after = self.depth + np.cumsum(step)
        free = ~inside & ~quote
        marks = free & ((text == COMMA) & (after == 1) | (step == 1) & (after == 1) | (step == -1) & (after == 0))
        start = 0
        for k in np.flatnonzero(marks).tolist():
            piece = self.carry + data[start:k]
            self.carry, start = b"" if step[k] == -1 else data[k : k + 1], k + 1
            if step[k] == 1:
                if piece.decode("utf-8", "replace").strip(MARK + " \t\r\n") or text[k] != 123 or self.cut or not self.first:
                    raise ValueError("the text is no JSON object")
            else:
                yield self.cut, piece + (b"}" if step[k] == -1 else b",")
            self.cut = True
        self.carry += data[start:]
        self.state, self.depth = state, int(after[-1]) if len(text) else self.depth


def parsed(entry: bytes) -> tuple[str | None, list[int] | None, str | None] | None:
    """path, numbers and what is wrong with an entry between its signs; None for the blank of an empty object."""
    body = entry[1:-1].decode("utf-8", "replace")
    if not body.strip() and entry[:1] + entry[-1:] == b"{}":
        return None
    try:
        ((path, vec),) = json.loads("{" + body + "}").items()
    except (ValueError, RecursionError):
        return None, None, "bad_entry"
    if not isinstance(vec, list) or not all(type(x) is int and -(1 << 31) <= x < 1 << 31 for x in vec):
        return path, None, "bad_entry"
    return path, vec, None


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes]]:
    """(file and block, its text) in order, batch by batch. What stood between two rows was the separator; one more stands at the end of a file."""
    for b in batches:
        files, starts, values = (b.column(c) for c in ("file", "start", "value"))
        keys = list(zip(files.to_pylist(), starts.to_pylist(), strict=True))
        at = 0
        texts = values.to_pylist()
        for k in range(1, len(keys) + 1):
            if k == len(keys) or keys[k] != keys[at]:
                yield keys[at], b"".join(t + SEPARATOR for t in texts[at:k])
                at = k


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """path, vec, problem (null, or bad_entry) of each entry of the object in each file below ``path``; written.

    Raises where a file holds no object, does not end it, or holds nothing in it. An entry that does not parse, or
    has no list of whole numbers, has its problem and what is known of it. A path that stands twice gives two rows.
    """
    raw = spark.read.option("lineSep", SEPARATOR.decode()).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, so_far, done = None, [], []
        for at, text in _blocks(batches):
            if at != key:
                if key:
                    done.append((*key, *(x for e in so_far for x in e)))
                key, so_far = at, [(k, 0) for k in range(3)]
            own = effects(text)
            so_far = [(own[s][0], d + own[s][1]) for s, d in so_far]
        if key:
            done.append((*key, *(x for e in so_far for x in e)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["file", "start", *(f"{n}{k}" for k in range(3) for n in "sd")])

    rows = raw.mapInArrow(summed, "file string, start bigint, s0 bigint, d0 bigint, s1 bigint, d1 bigint, s2 bigint, d2 bigint").collect()
    begin: dict[tuple[str, int], tuple[int, int, bool]] = {}
    ends: dict[str, tuple[int, int]] = {}
    for r in sorted(rows, key=lambda r: (r.file, r.start)):
        state, depth = ends.get(r.file, (OUTSIDE, 0))
        begin[r.file, r.start] = state, depth, r.file not in ends
        ends[r.file] = r[f"s{state}"], depth + r[f"d{state}"]
    if not ends or any(e != (OUTSIDE, -1) for e in ends.values()):  # the separator behind the object closes once more
        raise ValueError(f"{path} holds no annotations, or an object that does not end")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cutter, rows = None, Cutter(), []

        def end() -> None:
            if key and cutter.cut:  # what is left begins here and ends in a later block
                rows.append((*key, 1, cutter.carry, None, None, None))
            elif key:
                rows.append((*key, 0, cutter.carry, None, None, None))

        def batch() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.list_(pa.int32()), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "start", "torn", "piece", "path", "vec", "problem"])

        for at, text in _blocks(batches):
            if at != key:
                end()
                key, cutter = at, Cutter(*begin[at])
            for whole, entry in cutter.feed(text):
                if not whole:
                    rows.append((*key, 0, entry, None, None, None))
                elif (found := parsed(entry)) is not None:
                    rows.append((*key, None, None, *found))
            if rows:
                yield batch()
                rows = []
        end()
        if rows:
            yield batch()

    found = materialize(raw.mapInArrow(cut, "file string, start bigint, torn int, piece binary, path string, vec array<int>, problem string"), "entries")
    # A block has at most two torn pieces: the end of an entry from before it, and the beginning of one that goes on.
    torn = found.filter("torn is not null")
    order = Window.partitionBy("file").orderBy("start", "torn")
    owned = torn.withColumn("owner", F.last(F.when(F.col("torn") == 1, F.col("start")), True).over(order)).groupBy("file", "owner")
    pieces = owned.agg(F.array_sort(F.collect_list(F.struct("start", "torn", "piece"))).alias("pieces"))

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            entries = [b"".join(p["piece"] for p in row) for row in b.column("pieces").to_pylist()]
            # Behind the object stands the separator that no text had, and nothing else.
            if any(e.endswith(SEPARATOR) and e.strip() != SEPARATOR for e in entries):
                raise ValueError("something stands behind the object")
            rows = [p for p in (parsed(e) for e in entries if e.strip() != SEPARATOR) if p is not None]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.list_(pa.int32()), pa.string()), strict=True)], names=["path", "vec", "problem"])

    mended = materialize(pieces.select("pieces").mapInArrow(mend, "path string, vec array<int>, problem string"), "entries-mended")
    out = found.filter("torn is null").select("path", "vec", "problem").unionByName(mended)
    if out.isEmpty():
        raise ValueError(f"{path} holds no annotations")
    return out
