"""Exact, substring and near deduplication against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from presentia.llm import queries
from presentia.llm.components import components
from presentia.llm.exact_dedup import drop_copies, exact_dedup, identities
from presentia.llm.minhash import drop_near_copies, least_matches, near_duplicates
from presentia.llm.shingles import shingle_sets, word_hashes
from presentia.llm.substring_dedup import FMIndex, matching_statistics, shard_reports, substring_dedup
from tests.llm.helpers import LONG, awkward, docs, sha, with_clashing_columns
from tests.oracle import duck, same

WS = "[ \t-\r]"


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op2_substring_dedup"])
def test_queries_equal_their_sql(spark, sf, name):
    same(queries.queries()[name](spark, sf).toPandas(), duck(sf).sql(queries.oracle_sql()[name]).df())


def test_exact_dedup_of_awkward_rows(spark):
    out = exact_dedup(with_clashing_columns(awkward(spark)), block_bytes=16).collect()
    assert len(out) == 10 and sum(r.kept for r in out) == 4
    by = sorted((r.doc_id or -1, r.kept) for r in out)
    assert [x for x in by if x[0] != 7] == [(-1, False), (1, False), (2, False), (3, False), (4, True), (5, True), (6, False), (8, True)]
    assert [x for x in by if x[0] == 7] == [(7, False), (7, True)]
    empty = [r for r in out if r.doc_id in (2, 3, 4)]
    assert {r.keep_id for r in empty} == {4} and {r.group_size for r in empty} == {3}  # the blank text has most code points
    group = [r for r in out if r.doc_id in (1, 7, None)]
    assert {r.keep_id for r in group} == {7} and {r.group_size for r in group} == {4} and sum(r.kept for r in group) == 1


def test_exact_dedup_ties_go_to_the_smallest_id(spark):
    out = {r.doc_id: (r.keep_id, r.kept, r.text_sha256) for r in exact_dedup(docs(spark, [(9, "a b"), (4, "a\tb"), (6, "ab")])).collect()}
    assert out == {9: (4, False, sha("ab")), 4: (4, True, sha("ab")), 6: (4, False, sha("ab"))}


def test_block_hash_collisions_do_not_join_different_texts(spark):
    rows = [(i, f"{'x' * (i % 7)}{i % 40}" * 5) for i in range(120)]
    good = {r.doc_id: r.name for r in identities(docs(spark, rows), block_bytes=8).collect()}
    poor = {r.doc_id: (r.level, r.name) for r in identities(docs(spark, rows), block_bytes=8, block_hash=lambda b: F.pmod(F.xxhash64(b), F.lit(3))).collect()}
    texts = dict(rows)
    for i in texts:
        for j in texts:
            assert (poor[i] == poor[j]) == (texts[i] == texts[j])
    assert len(good) == len(poor)


def test_colliding_blocks_of_repeated_rows_are_named_by_their_bytes(spark, monkeypatch):
    rows = [(i // 3, "ab" * (i % 9) + "c" * (i % 4)) for i in range(60)] * 2
    df = docs(spark, rows).repartition(5)
    poor = identities(df, block_bytes=4, block_hash=lambda b: F.pmod(F.xxhash64(b), F.lit(2)))
    found = poor.collect()
    assert len(found) == 120
    names = {}
    for r in found:
        names.setdefault(r.text_sha256, set()).add((r.level, r.name))
    assert all(len(n) == 1 for n in names.values()) and len(set.union(*names.values())) == len(names) == len({t for _, t in rows})


def test_exact_dedup_of_an_empty_table_and_dropping(spark):
    assert exact_dedup(docs(spark, [(1, "x")]).limit(0)).count() == 0
    left = drop_copies(with_clashing_columns(awkward(spark)))
    before = with_clashing_columns(awkward(spark))
    assert left.columns == before.columns and left.count() == 4
    assert {tuple(r) for r in left.collect()} <= {tuple(r) for r in before.collect()} and drop_copies(before.limit(0)).count() == 0


def brute_substring(rows, window=13):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, ws in words.items():
        gone = set()
        for k in range(len(ws) - window + 1):
            if first[tuple(ws[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out[i] = (len(ws), len(gone), sha(kept))
    return out


def test_substring_dedup_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(6)]
    shared = [" ".join(rng.choice(vocabulary, 30)) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [" ".join(rng.choice(vocabulary, rng.integers(0, 25))) for _ in range(3)]
        rows.append((int(i * 3 % 61), "  ".join([parts[0], shared[i % 4], parts[1], "the same line " * int(rng.integers(0, 9)), parts[2]])))
    rows += [(100, LONG[:5000]), (101, LONG[:5000]), (102, "one two"), (103, None), (104, "")]
    expected = brute_substring(rows)
    for hot in (1000, 2):
        monkeypatch.setattr("presentia.llm.substring_dedup.HOT_SEGMENTS", hot)
        out = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(docs(spark, rows)).collect()}
        assert out == expected
    assert sum(v[1] for v in expected.values()) > 500


def test_substring_dedup_of_awkward_rows(spark):
    out = substring_dedup(with_clashing_columns(awkward(spark)), with_text=True).collect()
    assert len(out) == 10
    assert {r.doc_id: r.n_removed for r in out if r.doc_id in (5, 6)} == {5: 0, 6: 30_000}
    assert all(r.n_removed == 0 for r in out if r.doc_id in (7, None))
    assert substring_dedup(docs(spark, [(1, "x")]).limit(0)).count() == 0


def test_backward_search_counts_like_a_scan():
    rng = np.random.default_rng(1)
    text = np.append(rng.integers(1, 5, 400), 0)
    index = FMIndex(text, 5, 6)
    ends = np.arange(5, 400)
    stat, lo, hi = matching_statistics(index, text, ends, 6)
    as_text = "".join(map(str, text))
    for e, s, a, b in zip(ends.tolist(), stat.tolist(), lo.tolist(), hi.tolist(), strict=True):
        n = sum(as_text.startswith(as_text[e - 5 : e + 1], k) for k in range(400))
        if s == 6:
            assert b - a == n > 1
        else:
            assert sum(as_text.startswith(as_text[e - s : e + 1], k) for k in range(400)) == 1


def test_shard_reports_name_windows_of_smaller_docs():
    found = shard_reports([b"a b c d", b"x b c d", b"b c d e"], np.array([5, 3, 9]), window=3)
    assert found == [[1], [], [0]]


def brute_near(rows, size, percent):
    sets = {}
    for i, t in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(ws[k : k + size]) for k in range(len(ws) - size + 1)} if len(ws) >= size else {tuple(ws)} if ws else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("blocks", [512, 4])
def test_near_duplicates_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr("presentia.llm.minhash.BLOCK_CLASSES", blocks)
    rng = np.random.default_rng(3)
    rows, bases = [], [[f"t{b}w{k}" for k in range(60)] for b in range(3)]
    for i in range(70):
        words = list(bases[i % 3])
        for k in rng.choice(60, int(rng.integers(0, 5)), replace=False):
            words[k] = f"edit{rng.integers(0, 50)}"
        rows.append((int(200 - i), " ".join(words)))
    rows += [(300, "one two three"), (301, "ONE two\tthree"), (302, ""), (303, None), (304, "four"), (305, LONG), (306, LONG + " more")]
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs(spark, rows), 4, 80).collect()}
    assert out == brute_near(rows, 4, 80)


def test_near_duplicates_of_awkward_rows(spark):
    out = near_duplicates(with_clashing_columns(awkward(spark)), 4, 80).collect()
    assert len(out) == 10
    at = {r.doc_id: r.component_id for r in out if r.doc_id is not None}
    assert at[7] == at[1] == 1 and at[6] == 5 and at[2] == 2 and at[3] == 3 and at[4] == 4
    assert [r.component_id for r in out if r.doc_id is None] == [1]
    assert near_duplicates(docs(spark, [(1, "x")]).limit(0)).count() == 0
    left = drop_near_copies(with_clashing_columns(awkward(spark)), 4).collect()
    assert sorted(r.doc_id for r in left) == [1, 2, 3, 4, 5, 8] and {tuple(r) for r in left} <= {tuple(r) for r in with_clashing_columns(awkward(spark)).collect()}


def test_pruning_keeps_its_miss_probability():
    assert least_matches(80) == sorted(least_matches(80)) and least_matches(80)[-1] < 0.8 * 128


def test_components_of_a_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(got[k] == 0 for k in range(1, 41)) and all(got[k] == 100 for k in range(101, 130))


def test_word_hashes_see_words_not_places():
    whole = b"ab  cd\nab" + b"cd ab"
    hashes, at, _, _ = word_hashes(whole, np.array([0, 9, 14]))
    assert at.tolist() == [0, 3, 5] and hashes[0] == hashes[2] == hashes[4] and hashes[1] == hashes[3] != hashes[0]
    assert [len(s) for s in shingle_sets(b"a b c d e" + b"" + b"a b", np.array([0, 9, 9, 12]), 4)] == [2, 0, 1]
