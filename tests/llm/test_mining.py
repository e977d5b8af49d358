"""Hard negatives, spelling variants and token files."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyarrow import fs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from presentia.llm import hard_negatives as hard
from presentia.llm import queries, spelling, token_files
from presentia.plans.materialize import scratch_path
from tests.llm.helpers import LONG, awkward, docs, with_clashing_columns
from tests.oracle import duck, same

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_spelling_variants"])
def test_queries_equal_their_sql(spark, sf, name):
    same(queries.queries()[name](spark, sf).toPandas(), duck(sf).sql(queries.oracle_sql()[name]).df())


VECTORS = "vec_id bigint, embedding array<float>, label int"


def brute_negatives(rows, is_anchor, scale=1.0, k=5, percent=80):
    """By all inner products, on one row for each id."""
    one = {}
    for i, x, label in rows:
        if i is not None and label is not None and x is not None and all(v is not None and np.isfinite(v) for v in x):
            one[i] = min(one.get(i, (label, x)), (label, x))
    q = {i: (label, [int(np.floor(scale * v)) for v in x]) for i, (label, x) in one.items()}
    out = []
    for a, (label, x) in q.items():
        if not is_anchor(a):
            continue
        scores = sorted((-sum(u * v for u, v in zip(x, y, strict=False)), i) for i, (_, y) in q.items() if i != a)
        for ps, p in [s for s in scores if q[s[1]][0] == label][:k]:
            inside = [(s, i) for s, i in scores if q[i][0] != label and percent * -ps <= 100 * -s <= 100 * -ps][:k]
            out += [(a, p, r, i, -ps, -s) for r, (s, i) in enumerate(inside, 1)]
    return sorted(out)


def mined(df, **options):
    return sorted(tuple(r) for r in hard.hard_negatives(df, F.col("vec_id") % 4 == 0, **options).collect())


def test_negatives_equal_brute_force_with_ties_copies_and_small_shards(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) + (i % 3) for _ in range(12)], i % 3) for i in range(150)]
    rows += [(150 + i, [1.0] * 12, i % 2) for i in range(60)]  # a group of copies under two labels
    rows += [(210 + i, [float(rng.randrange(3)) for _ in range(12)], i % 4) for i in range(60)]  # many ties
    monkeypatch.setattr(hard, "SHARD_COMPONENTS", 400)
    for scale in (4, 1):
        assert mined(spark.createDataFrame(rows, VECTORS), scale=scale) == brute_negatives(rows, lambda i: i % 4 == 0, scale)


def test_negatives_of_awkward_rows(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(1, 1) for _ in range(6)], i % 2) for i in range(40)]
    rows += [(None, [1.0] * 6, 1), (40, None, 1), (41, [1.0, None], 0), (42, [float("nan")] * 6, 1), (43, [float("inf")] * 6, 0), (44, [9.0] * 6, None)]
    rows += [(48, [], 0), (49, [3.0, 2.0], 1), (52, [0.0] * 6, 1), (0, [0.1] * 6, 1), (3, rows[3][1], 1), (3, rows[3][1], 1)]  # short, empty, zero, repeated ids
    df = with_clashing_columns(spark.createDataFrame(rows, VECTORS))
    assert mined(df, scale=8) == brute_negatives(rows, lambda i: i % 4 == 0, 8)
    assert mined(df.limit(0)) == [] and mined(df.filter("vec_id % 4 = 1")) == []
    huge = [(i, [1e30 * (1 + i % 3), 1e30], i % 2) for i in range(8)]
    limit = (1 << 63) - 1
    assert {(r[4], r[5]) for r in mined(spark.createDataFrame(huge, VECTORS))} == {(limit, limit)}


def test_bounds_hold_for_every_row_and_an_index_leaves_dimensions_out():
    rng = np.random.default_rng(3)
    vectors = np.floor(256 * rng.normal(size=(300, 24)))
    shard = hard.Shard(np.arange(300), np.zeros(300, np.int64), vectors, 6)
    sizes = []
    for cosine in (0.0, 0.4, 0.8):
        index = shard.index((0, 300), cosine)
        sizes.append(sum(len(r) for r, _ in index.postings))
        bound = index.partial_scores(shard.unit[:20]) + index.remaining[:, None] + hard.SLACK
        assert (bound >= (vectors / np.linalg.norm(vectors, axis=1)[:, None]) @ shard.unit[:20].T - 1e-9).all()
        assert (index.remaining <= cosine / 2 + 1e-6).all()
    assert sizes[0] > sizes[1] > sizes[2]


def brute_words(rows, damage=None, length=5, least=3):
    counts = Counter()
    for i, text in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in spelling.RUN.findall(lower):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if damage and h % damage == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= length and n >= least}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute_groups(words, ratio=2):
    form, out = {}, []
    of = {w: sorted((-words[v], v) for v in words if near(w, v)) for w in words}
    for w, n in words.items():
        form[w] = of[w][0][1] if of[w] and -of[w][0][0] >= ratio * n else None
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(of[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def texts_of_near_words(seed, letters="abé", n=260):
    """Few letters and short words: many near ones, many shared grams."""
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(5, 10))) for _ in range(n)}
    return [(i, " ".join(rng.choice(sorted(words)) for _ in range(400))) for i in range(12)]


@pytest.mark.parametrize("long_list", [2, 64])
def test_groups_equal_brute_force(spark, monkeypatch, long_list):
    monkeypatch.setattr(spelling.near_pairs, "__defaults__", (long_list,))
    monkeypatch.setattr(spelling, "LEAST_LIST", 3)
    rows = texts_of_near_words(long_list)
    rows += [(20, "internationalisation " * 9 + "internationalization " * 3 + "interrnationalisation " * 4 + "abcdefghijk " * 5 + "bcdefghijk " * 3 + "abcdefghij " * 3), (21, "zebraones " * 3 + "zebraonet " * 7 + "zebrbonet " * 20)]
    found = sorted(tuple(r) for r in spelling.spelling_groups(docs(spark, rows), damage=7).collect())
    assert found == brute_groups(brute_words(rows, 7))
    assert any(r[1] and r[2] != r[1] for r in found)  # a chain of forms


def test_groups_of_awkward_rows(spark):
    df = with_clashing_columns(awkward(spark))
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in spelling.spelling_groups(df, damage=5).collect()) == brute_groups(brute_words(rows, 5))
    long = "x" * 30_000
    rows = [(1, f"{long} {long} {long}"), (2, f"{long}y " * 7), (None, "×÷ééé " * 3)]
    assert sorted(tuple(r) for r in spelling.spelling_groups(docs(spark, rows)).collect()) == brute_groups(brute_words(rows))
    assert spelling.spelling_groups(df.limit(0)).count() == 0


def test_no_edit_affects_all_grams_and_near_words_share_an_indexed_one():
    rng = random.Random(11)
    words = sorted({"".join(rng.choice("aabcd") for _ in range(rng.randrange(5, 14))) for _ in range(3000)})
    counts = Counter(s[p : p + q] for s in ("<" + w + ">" for w in words) for q in range(2, 7) for p in range(len(s) - q + 1))
    for least in (0, 20, 200, 10_000):
        kept = {g: n for g, n in counts.items() if len(g) == 2 or counts[g[:-1]] > least}
        grams = spelling.Grams(kept)

        def keys(word, shorter, grams=grams):
            s = "<" + word + ">"
            return {s[:e] for e, _ in grams.indexed(word, shorter) if e < len(s)} | {s[p:] for _, p in grams.indexed(word, shorter) if p}

        for word in rng.sample(words, 150):
            for shorter in (len(word), len(word) - 1):
                if shorter >= 5:
                    s, q = "<" + word + ">", min(spelling.LONGEST, (shorter + 2) // 2)
                    cut = grams.cut(s, q)
                    assert grams.affected(s, cut, q) < len(cut)
            for _ in range(12):  # an edit that leaves letters whose pairs the dictionary knows
                k = rng.randrange(len(word))
                other = rng.choice([word[:k] + rng.choice("abcd") + word[k + 1 :], word[:k] + rng.choice("abcd") + word[k:], word[:k] + word[k + 1 :]])
                s = "<" + other + ">"
                if near(word, other) and len(other) >= 5 and all(s[p : p + 2] in kept for p in range(len(s) - 1)):
                    shorter = min(len(word), len(other))
                    assert keys(word, shorter) & keys(other, shorter), (least, word, other)


@pytest.mark.parametrize("bits", range(1, 33))
def test_bit_fields_come_back(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 777).astype("<u4")
    data = token_files.pack(ids, bits)
    assert len(data) == -(-777 * bits // 8) and (token_files.unpack(data, bits, 777) == ids).all()


def test_a_file_is_read_at_any_place(tmp_path):
    local, rng = fs.LocalFileSystem(), np.random.default_rng(4)
    parts = [rng.integers(0, 1000, n).astype("<u4") for n in (0, 1, 70, 0, 3, 8, 200, 64, 5)]
    writer = token_files.IdFileWriter(local, f"{tmp_path}/x", token_files.bits_for(1000), block=16)
    for k, ids in enumerate(parts):
        writer.add(None if k == 1 else k, ids)
    writer.close()
    reader, whole = token_files.IdFileReader(local, f"{tmp_path}/x"), np.concatenate(parts)
    assert reader.bits == 10 and reader.documents == [0, None, *range(2, 9)]
    for a in range(0, len(whole), 7):
        for b in (a, a + 1, a + 15, a + 16, a + 17, len(whole)):
            assert (reader.read(a, b) == whole[a:b]).all()
    assert all((reader.document(k) == ids).all() for k, ids in enumerate(parts))
    assert np.concatenate([ids for _, ids, _ in reader.pieces()]).tolist() == whole.tolist()
    assert [k for k, _, last in reader.pieces() if last] == list(range(9))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def test_slices_are_encoded_like_whole_texts(library):
    rng = np.random.default_rng(2)
    parts = ["'", "s", "re", "'ll", "'ve", " ", "  ", "\n", "\t", "a", "Z", "é", "1", "²", "　", ".", "!", "中", "\U0001f600", "\x1c", "\x85", "​", "́", "x" * 90]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(1500)] + ["", "ab'" * 500, " " * 200, LONG[:20_000], "a<|endoftext|> b"]
    encoder = token_files.Encoder(open(VOCABULARY, encoding="utf-8").read())
    assert encoder.sliced
    found = [x.tolist() for x in encoder.encode([t.encode() for t in texts])]
    assert found == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_vocabularies_go_through_the_library_whole():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = token_files.Encoder(open(path, encoding="utf-8").read())
    assert not encoder.sliced
    assert encoder.encode([b"A Test", b""])[0].tolist() == Tokenizer.from_file(path).encode("A Test", add_special_tokens=False).ids


def brute_tokens(rows, library):
    out, at = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_token_query_equals_brute_force(spark, sf, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in queries.op13_token_files(spark, sf).collect()) == sorted(brute_tokens(rows, library))


def test_tokens_of_awkward_rows_in_small_files(spark, library):
    df = with_clashing_columns(awkward(spark))
    path = scratch_path(spark, "test-tokens")
    index = token_files.write_token_files(df, VOCABULARY, path, block=64, file_ids=100)
    left = fs.FileSystem.from_uri(path)
    left[0].open_output_stream(f"{left[1]}/ids-000000-999999-0.bin").close()  # what a failed attempt leaves
    token_files.sweep(index, path)
    assert {i.base_name for i in left[0].get_file_info(fs.FileSelector(left[1]))} == {r.file for r in index.collect()}
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    key = lambda r: (r[0] is not None, *[x or 0 for x in r])
    found = sorted((tuple(r) for r in token_files.read_token_files(index, path).collect()), key=key)
    assert found == sorted(brute_tokens(rows, library), key=key) and index.count() > 3
    assert token_files.token_round_trip(spark, df.limit(0), VOCABULARY).count() == 0
