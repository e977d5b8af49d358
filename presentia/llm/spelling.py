"""Spelling variants: groups of words one edit apart, by an index of variable-length grams.

1. Words are counted in the tasks and summed; the vocabulary is what is long and frequent enough.
2. The gram dictionary is a trie of the padded words' grams: all of two characters, and longer ones only
   as extensions of grams that are frequent in the vocabulary. A gram is frequent if it holds more than a
   ``FREQUENT``-th of all positions, so the dictionary's size is bounded whatever the vocabulary's.
3. A word is cut into the longest gram of the dictionary at each place, without those inside another.
   For each place an edit can have, the grams are counted that it may affect: those it touches and those
   that a new gram across the edit could replace. The largest count is the word's bound: all but so many
   grams survive in any word one edit away.
4. Two near words share a gram that no edit affects. In one order of all grams by frequency, the rarest
   shared one is among the bound + 1 rarest of either word, so only these are indexed. As the edit is on
   one side of a shared gram, the other side is equal: a list holds words that share the gram together
   with all that stands before it (or after it), for one length of the shorter word.
5. Lists are merged by self-joins on their key and pairs verified by edit distance. Lists of more than
   ``LONG_LIST`` words are cut further by what is left of the word with one character taken out, which no
   near pair escapes and which leaves no long list.

Grams are limited to half of the padded shorter word, which leaves at least one unaffected gram for
every edit of every word; see the tests.
"""

from __future__ import annotations

import functools
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presentia.llm.arrow_text import bounded
from presentia.plans.materialize import materialize

#: Lower-cased letters of Latin-1; only A-Z have been lowered.
RUN = re.compile("[a-zÀ-ÿ]+")
#: Longest grams.
LONGEST = 6
#: A gram is extended if it holds more than this share (one in so many) of all positions, and more than ``LEAST_LIST``.
FREQUENT, LEAST_LIST = 2000, 16
#: Words of a list beyond which it is cut further.
LONG_LIST = 64
#: Different words or grams that a task counts before it passes them on.
HELD_WORDS = 200_000
#: Characters that are split at a time.
PIECE = 1 << 20
START, END = "<", ">"


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters that do not cut a run."""
    at = 0
    while at < len(text):
        to = at + size
        if to < len(text) and (inside := RUN.match(text, to)):
            to = inside.end()
        yield text[at:to]
        at = to


def _counts(counts: Counter, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=[name, "n"])


def word_counts(docs: DataFrame, least_length: int, least_count: int, damage: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words that are long and frequent enough.

    With ``damage``, a run whose crc32 together with its document's id is divisible by it loses one character.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in bounded(batches, "text"):
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                before = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
                for piece in pieces(text.lower().decode("utf-8", "replace")):
                    for word, n in Counter(RUN.findall(piece)).items():
                        if damage is not None and (h := zlib.crc32(word.encode(), before)) % damage == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        if len(word) >= least_length:
                            counts[word] += n
                if len(counts) >= HELD_WORDS:
                    yield _counts(counts, "word")
                    counts = Counter()
        if counts:
            yield _counts(counts, "word")

    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return materialize(src.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count), "spelling-words")


def gram_dictionary(words: DataFrame, longest: int = LONGEST) -> dict[str, int]:
    """How many places of the padded words hold each gram: all pairs of characters, then extensions of frequent grams.

    At most ``FREQUENT`` grams of a length are frequent and each has as many extensions as there are letters, so
    what is collected is bounded by the alphabet.
    """
    positions = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    least = max(LEAST_LIST, positions // FREQUENT)
    found: dict[str, int] = {}
    frequent: set[str] | None = None
    for q in range(2, longest + 1):

        def run(batches: Iterator[pa.RecordBatch], q: int = q, frequent: set[str] | None = frequent) -> Iterator[pa.RecordBatch]:
            counts: Counter = Counter()
            for b in batches:
                for word in b.column("word").to_pylist():
                    s = START + word + END
                    counts.update(s[p : p + q] for p in range(len(s) - q + 1) if frequent is None or s[p : p + q - 1] in frequent)
            if counts:
                yield _counts(counts, "gram")

        level = {g: n for g, n in words.select("word").mapInArrow(run, "gram string, n bigint").groupBy("gram").agg(F.sum("n")).collect()}
        found |= level
        frequent = {g for g, n in level.items() if n > least}
        if not frequent:
            break
    return found


class Grams:
    """Cuts words by a gram dictionary and bounds what an edit can affect."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.heads = {g[:-1] for g in counts}
        self.tails: dict[str, int] = {}
        for g in counts:
            for k in range(1, len(g)):
                if self.tails.get(g[k:], 1 << 30) > len(g):
                    self.tails[g[k:]] = len(g)

    def cut(self, s: str, q: int) -> list[tuple[int, int]]:
        """(start, end) of the longest gram of at most ``q`` characters at each place, without those inside an earlier one."""
        out, reach = [], 0
        for p in range(len(s) - 1):
            e = p + 2
            while e < len(s) and e - p < q and s[p : e + 1] in self.counts:
                e += 1
            if e > reach:
                out.append((p, e))
                reach = e
        return out

    def affected(self, s: str, cut: list[tuple[int, int]], q: int) -> int:
        """The most grams of ``cut`` that one edit between the padding can change."""
        starts, ends = [p for p, _ in cut], [e for _, e in cut]
        before, after = [0] * len(s), [0] * (len(s) + 1)  # grams that stay left and right of an edit
        for i in range(1, len(s)):
            longest = next((k for k in range(min(q - 1, i), 0, -1) if s[i - k : i] in self.heads), 0)
            before[i] = min(bisect_right(ends, i), bisect_left(starts, i - longest))
            longest = next((k for k in range(min(q - 1, len(s) - i), 0, -1) if self.tails.get(s[i : i + k], q + 1) <= q), 0)
            after[i] = len(cut) - max(bisect_left(starts, i), bisect_right(ends, i + longest))
        put_in = (len(cut) - before[i] - after[i] for i in range(1, len(s)))
        changed = (len(cut) - before[i] - after[i + 1] for i in range(1, len(s) - 1))
        return max(0, *put_in, *changed)

    def indexed(self, word: str, shorter: int) -> list[tuple[int, int]]:
        """(end of the first, start of the last copy) of each gram that lists of pairs with a shorter word of ``shorter`` characters need.

        What an edit leaves of the copies of a gram holds the first of them, before the edit, or the last, behind it.
        """
        s, q = START + word + END, min(LONGEST, (shorter + 2) // 2)
        cut = self.cut(s, q)
        ranked = sorted((self.counts.get(s[p:e], 0), s[p:e], p, e) for p, e in cut)
        last = ranked[min(self.affected(s, cut, q) + 1, len(ranked)) - 1][:2]
        out: dict[str, tuple[int, int]] = {}
        for n, g, p, e in ranked:
            if (n, g) > last:
                break
            out[g] = (out[g][0] if g in out else e, p)
        return list(out.values())


@functools.lru_cache(maxsize=1)
def _grams(key: int, held: object) -> Grams:
    return Grams(held.value)


def _hashes(s: str) -> list[int]:
    """Hashes of all beginnings of ``s``. Equal ones only make candidates, which are verified."""
    out = [0]
    for c in s:
        out.append((out[-1] * 0x9E3779B97F4A7C15 + ord(c) + 1) % ((1 << 61) - 1))
    return out


def gram_lists(words: DataFrame, counts: dict[str, int], least_length: int) -> DataFrame:
    """(key, word, n, base, cut): the lists' entries; ``base`` words have the shorter length of their list.

    ``cut`` is where the gram ends, if all before that is shared, or minus where it starts. Written.
    """
    held = words.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = _grams(id(held), held)
        names, kinds = ("shorter", "place", "hash", "word", "n", "base", "cut"), (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int32())
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                rows = []
                for word, n in zip(part.column("word").to_pylist(), part.column("n").to_pylist(), strict=True):
                    s = START + word + END
                    to, back = _hashes(s), _hashes(s[::-1])
                    for shorter in (len(word) - 1, len(word)):
                        if shorter >= least_length:
                            for e, p in grams.indexed(word, shorter):
                                if e < len(s):
                                    rows.append((shorter, e, to[e], word, n, shorter == len(word), e))
                                if p:
                                    rows.append((shorter, p - len(s), back[len(s) - p], word, n, shorter == len(word), -p))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))

    entries = words.mapInArrow(run, "shorter int, place int, hash bigint, word string, n bigint, base boolean, cut int")
    out = materialize(entries.select(F.xxhash64("shorter", "place", "hash").alias("key"), "word", "n", "base", "cut"), "spelling-lists")
    held.destroy()
    return out


def _merged(lists: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): the pairs of each list that are exactly one edit apart, once for each list that shows them."""
    a = lists.filter("base").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = lists.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("base").alias("same"))
    once = ~F.col("same") | (F.col("a") < F.col("b"))
    return a.join(b, "key").filter(once & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")


def near_pairs(lists: DataFrame, long_list: int = LONG_LIST) -> DataFrame:
    """(a, a_n, b, b_n) of all near words, each pair once; written."""
    long = materialize(lists.groupBy("key").count().filter(F.col("count") > long_list).select("key"), "spelling-long")
    short = lists.join(long, "key", "left_anti")
    padded = F.concat(F.lit(START), "word", F.lit(END))
    rest = F.when(F.col("cut") > 0, F.substring(padded, F.col("cut") + 1, F.length(padded))).otherwise(F.substring(padded, F.lit(1), -F.col("cut")))
    kept = lists.join(long, "key", "left_semi").withColumn("rest", rest)
    without = F.transform(F.sequence(F.lit(1), F.length("rest")), lambda j: F.concat(F.substring(F.col("rest"), F.lit(1), j - 1), F.substring(F.col("rest"), j + 1, F.length("rest"))))
    placed = F.transform(without, lambda x, j: F.concat(j.cast("string"), F.lit(":"), x))
    variants = F.when(F.col("base"), F.concat(F.array("rest"), placed)).otherwise(F.array_distinct(without))
    cut = kept.select("key", "word", "n", "base", F.explode(variants).alias("variant"))
    pairs = _merged(short).unionByName(_merged(cut.select(F.xxhash64("key", "variant").alias("key"), "word", "n", "base")))
    return materialize(pairs.dropDuplicates(["a", "b"]), "spelling-pairs")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last form of each chain.

    Pointers are doubled until none moves; a form is at least twice as frequent as its word, so chains are short.
    """
    own = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = own.select(F.col("word").alias("root"), F.col("root").alias("later"))
        own = materialize(own.join(step, "root", "left").select("word", F.coalesce("later", "root").alias("root"), F.col("later").isNotNull().alias("moved")), "spelling-roots")
        if not own.filter("moved").limit(1).count():
            return own.select("word", "root")
        own = own.drop("moved")


def spelling_groups(docs: DataFrame, least_length: int = 5, least_count: int = 3, ratio: int = 2, damage: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of at least ``least_length`` characters and ``least_count`` occurrences.

    Words are maximal runs of Latin-1 letters with A-Z lowered. A word's form is its near word (one character put
    in, taken out or replaced) of the most occurrences, ties by code points, if it has ``ratio`` times the word's;
    its root is the last of the chain of forms. ``ratio`` is over 1, so chains end.

    Null and empty texts have no words; a null id counts as an empty one in ``damage``; repeated rows count as often
    as they occur; very long texts are split in pieces and very long words compared whole; an empty table gives no
    rows. Other columns, whatever their names, are not read.
    """
    if ratio < 2 or least_length < 2:
        raise ValueError("the ratio and the least length are at least 2")
    words = word_counts(docs, least_length, least_count, damage, id_col, text_col)
    pairs = near_pairs(gram_lists(words, gram_dictionary(words), least_length))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    fits = -F.col("best.less") >= ratio * F.col("n")
    named = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"))
    named = materialize(named, "spelling-named")
    last = roots(named.filter("form is not null").select("word", "form"))
    return named.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
