"""License scans: base phrases, and an exact set-similarity join of text blocks with licence templates.

The templates are a fixed short list, so the join is one-sided: blocks stream past an index of the
templates. Tokens are ordered by how many documents of the corpus have them, rarest first (one pass that
counts the template vocabulary over all documents). If a block holds at least ``o = ceil(t * |T|)`` of a
template's tokens, it holds one of the template's ``|T| - o + 1`` rarest: only these prefix tokens are
indexed. Blocks with fewer than ``o`` template tokens fall to the length filter, pairs whose first common
token leaves too few behind it to the positional filter, and the rest are counted exactly.

A block is a run of words, one starting every half of it, so any passage of half a block lies whole in one.
Templates are classed by their length: those of a class are met by blocks of twice the class's words, ``BLOCK``
at least, so a template of any length lies whole in a block, and short ones are not met by chance in long blocks.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presentia.llm.arrow_text import bounded

# Phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notices of public licences in lower case, words only, and the labels they add.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl-notice", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("mit-notice", "released under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("proprietary", "all rights reserved no part of this work may be reproduced without the prior written permission of the publisher"),
]
BLOCK, STRIDE, THRESHOLD = 64, 32, 0.9

#: Letters A-Z in lower case; bytes that are neither digits, letters nor parts of longer characters become blanks.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text."""
    return text.translate(FOLD).split()


def vocabulary(templates=TEMPLATES) -> frozenset[bytes]:
    return frozenset(w for _, t in templates for w in t.encode().split())


def token_frequencies(docs: DataFrame, text_col: str = "text", templates=TEMPLATES) -> dict[bytes, int]:
    """In how many documents each template token occurs; at most one row for each token is collected."""
    wanted = vocabulary(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for b in bounded(batches, "text", 4 << 20):
            for t in b.column("text").to_pylist():
                seen.update(wanted.intersection(words_of(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])

    counted = docs.selectExpr(f"`{text_col}` as text").mapInArrow(run, "token binary, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    return {bytes(r.token): r.n for r in counted.collect()}


@dataclass
class TemplateIndex:
    """Templates in global token order, and which of them each prefix token may lead to."""

    rank: dict[bytes, int] = field(default_factory=dict)
    labels: list[str] = field(default_factory=list)
    tokens: list[frozenset[bytes]] = field(default_factory=list)
    needed: list[int] = field(default_factory=list)
    prefix: dict[bytes, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))
    block: int = BLOCK
    stride: int = STRIDE

    @classmethod
    def build(cls, frequencies: dict[bytes, int], templates=TEMPLATES, threshold: float = THRESHOLD, stride: int = STRIDE) -> TemplateIndex:
        out = cls(block=2 * stride, stride=stride)
        order = sorted(vocabulary(templates), key=lambda w: (frequencies.get(w, 0), w))
        out.rank = {w: k for k, w in enumerate(order)}
        for label, text in templates:
            own = sorted(set(text.encode().split()), key=out.rank.__getitem__)
            need = math.ceil(threshold * len(own) - 1e-9)
            for at, w in enumerate(own[: len(own) - need + 1]):
                out.prefix[w].append((len(out.tokens), at))
            out.labels.append(label)
            out.tokens.append(frozenset(own))
            out.needed.append(need)
        return out

    def matches(self, words: list[bytes]) -> tuple[set[str], float]:
        """The labels of all templates met by a block of ``words``, and the best containment met."""
        hits = set(self.prefix).intersection(words)
        if not hits:
            return set(), 0.0
        found, best = set(), 0.0
        for block in self._blocks(words, hits):
            own = sorted(self.rank.keys() & block, key=self.rank.__getitem__)
            tried = set()
            for at, w in enumerate(own):
                for k, place in self.prefix.get(w, ()):
                    if k in tried:
                        continue
                    tried.add(k)  # w is the first common token: an earlier one would have led here already
                    size, need = len(self.tokens[k]), self.needed[k]
                    if len(own) < need or min(size - place, len(own) - at) < need:
                        continue
                    if (common := len(self.tokens[k].intersection(own))) >= need:
                        found.add(self.labels[k])
                        best = max(best, common / size)
        return found, best

    def _blocks(self, words: list[bytes], hits: set[bytes]) -> Iterator[set[bytes]]:
        """The blocks that hold a prefix token."""
        block, stride = self.block, self.stride
        starts = sorted({s for i, w in enumerate(words) if w in hits for s in range(max(0, (i - block) // stride + 1) * stride, i + 1, stride)})
        last = max(0, -(-(len(words) - block) // stride)) * stride  # the first block that reaches the end
        for s in sorted({min(s, last) for s in starts}):
            yield set(words[s : s + block])


def stride_for(template: str) -> int:
    """The class of a template: its words, up to the next power of two, ``STRIDE`` at least."""
    return max(STRIDE, 1 << (len(template.split()) - 1).bit_length())


def indexes(frequencies: dict[bytes, int], templates=TEMPLATES, threshold: float = THRESHOLD) -> list[TemplateIndex]:
    """An index for each class of lengths; templates without words meet nothing."""
    classes = defaultdict(list)
    for label, text in templates:
        if text.split():
            classes[stride_for(text)].append((label, text))
    return [TemplateIndex.build(frequencies, own, threshold, stride) for stride, own in sorted(classes.items())]


def base_places(words: list[bytes]) -> tuple[list[int], set[str]]:
    """Where the base phrases start, in words from 0, and their labels."""
    text = b" " + b" ".join(words) + b" "
    places, labels = [], set()
    for phrase, label in BASE_PHRASES.items():
        needle = b" " + phrase.encode() + b" "
        at, seen, counted = text.find(needle), 0, 0
        while at >= 0:
            labels.add(label)
            seen += text.count(b" ", counted, at)
            counted = at
            places.append(seen)
            at = text.find(needle, at + 1)
    return places, labels


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    ``labels`` has the base labels and those of all templates met; both are distinct, sorted and joined by
    commas. ``score`` is 1 where a base phrase stands, else the best containment at or above the
    threshold, else 0. Null counts as empty: no words, no labels. Very long texts are scanned to their end, block
    by block; templates may be of any length, their words in lower case; of several places the smallest and the largest are named. Repeated rows give repeated results, an
    empty table gives none. Other columns, whatever their names, are not read.
    """
    index = docs.sparkSession.sparkContext.broadcast(indexes(token_frequencies(docs, text_col, templates), templates, threshold))
    schema = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    names = [c.split()[0] for c in schema.split(", ")]

    def scan(text: bytes) -> tuple:
        words = words_of(text)
        places, base = base_places(words)
        met = [part.matches(words) for part in index.value]
        own, best = set().union(*(x for x, _ in met)), max((y for _, y in met), default=0.0)
        first, last = (min(places), max(places)) if places else (None, None)
        return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(base | own)), 1.0 if places else best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "text", 4 << 20):
            cols = zip(*map(scan, b.column("text").to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types[1:], strict=True))], names=names)

    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").mapInArrow(run, schema)
