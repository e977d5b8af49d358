"""Tokens, licences, pages, archives, fingerprints, toxicity, mixing and the pipeline."""

import hashlib
import re
import time
from collections import Counter
from html import unescape

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyarrow import fs
from pyspark.sql import functions as F

import corpus_pipeline
from presentia.llm import imatch, license_scan, mixing, queries, toxicity, warc
from presentia.llm.bpe import bpe_decode, bpe_encode, bpe_round_trip, encode_batch, merger, read_ranks
from presentia.llm.html_extract import extract_text, html_extract
from tests.llm.test_dedup import brute_near
from tests.llm.helpers import LONG, awkward, docs, sha, with_clashing_columns
from tests.oracle import duck, same

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.mark.parametrize("name", ["op3_warc", "op6_mixing"])
def test_queries_equal_their_sql(spark, sf, name):
    same(queries.queries()[name](spark, sf).toPandas(), duck(sf).sql(queries.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_queries_give_a_row_for_each_input_row(spark, sf, name):
    table = "pages" if name.startswith(("op3", "op5")) else "documents"
    assert queries.queries()[name](spark, sf).count() == spark.read.parquet(f"{sf}/{table}.parquet").count()


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merger(read_ranks(RANKS)).ranks, special_tokens={})


def test_bpe_equals_the_library_on_odd_texts(encoding):
    rng = np.random.default_rng(2)
    parts = ["'", "s", "re", "'ll", "'ve", " ", "  ", "\n", "\t", "a", "Z", "é", "1", "²", " ", ".", "!", "中", "\U0001f600", "\x1c", "\x85", "x" * 90]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(1500)] + ["", "ab'" * 500, " " * 200, LONG[:20_000]]
    ids, offsets = encode_batch([t.encode() for t in texts], merger(read_ranks(RANKS)))
    for t, i, o in zip(texts, ids, offsets, strict=True):
        assert np.frombuffer(b"".join(i), "<u4").tolist() == encoding.encode_ordinary(t)
        assert o == sorted(o) and (not o or o[0] == 0)


def test_bpe_of_awkward_rows(spark, encoding):
    df = with_clashing_columns(awkward(spark))
    out = bpe_round_trip(df, RANKS).collect()
    texts = sorted(t or "" for (t,) in df.select("text").collect())
    assert sorted(r.decoded_sha256 for r in out) == sorted(map(sha, texts))
    assert sorted(r.ids_sha256 for r in out) == sorted(sha(np.array(encoding.encode_ordinary(t), "<u4").tobytes()) for t in texts)
    encoded = bpe_encode(df, RANKS)
    assert sorted(bytes(r.decoded) for r in bpe_decode(encoded, RANKS).collect()) == sorted(t.encode() for t in texts)
    assert bpe_round_trip(df.limit(0), RANKS).count() == 0


def brute_license(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [k for p in license_scan.BASE_PHRASES for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    base = {v for p, v in license_scan.BASE_PHRASES.items() if any(words[k : k + len(p.split())] == p.split() for k in range(len(words)))}
    found, best, start = set(), 0.0, 0
    while start == 0 or start - license_scan.STRIDE + license_scan.BLOCK < len(words):
        block = set(words[start : start + license_scan.BLOCK])
        for label, t in license_scan.TEMPLATES:
            own = set(t.split())
            share = len(own & block) / len(own)
            if share >= license_scan.THRESHOLD - 1e-9:
                found, best = found | {label}, max(best, share)
        start += license_scan.STRIDE
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if places else best


def test_license_scan_against_brute_force(spark):
    filler = " ".join(f"f{k}" for k in range(50))
    rows = [(k, f"{filler} {t.title()}! {filler}") for k, (_, t) in enumerate(license_scan.TEMPLATES)]
    rows += [(100, "MIT-License, mit license; CC-BY cc by by"), (101, None), (102, ""), (103, LONG), (104, "the license of the software is free to use and copy " * 30), (105, "mit license " * 500)]
    out = {r.doc_id: tuple(r)[1:] for r in license_scan.license_scan(docs(spark, rows)).collect()}
    for i, t in rows:
        expected = brute_license(t)
        assert out[i][:-1] == expected[:-1] and out[i][-1] == pytest.approx(expected[-1]), i
    assert license_scan.license_scan(with_clashing_columns(awkward(spark))).count() == 10


def test_license_templates_of_any_length_are_found_wherever_they_stand(spark):
    words = [f"term{k}" for k in range(700)]
    templates = [(f"t{n}", " ".join(words[:n] if n < 500 else words[::-1][:n])) for n in (5, 33, 60, 100, 600)] + [("none", "")]
    rows = [(n * 1000 + at, "other words " * at + t + " and more" * 50) for (name, t), n in zip(templates[:5], (5, 33, 60, 100, 600), strict=True) for at in range(0, 64, 3)]
    out = {r.doc_id: r for r in license_scan.license_scan(docs(spark, rows), templates=templates).collect()}
    assert all(f"t{k // 1000}" in out[k].labels.split(",") and out[k].score == 1.0 for k, _ in rows)
    spread = " ".join(w + " and" * 40 for w in words[:5])  # all words of a short template, far apart
    assert license_scan.license_scan(docs(spark, [(1, spread)]), templates=templates).first().labels == ""


def test_license_scan_of_an_empty_table(spark):
    assert license_scan.license_scan(awkward(spark).limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site for all kinds of things</div><div id="content"><div class="post"><h1>Head &amp; tail</h1><p>One  two<b> three</b>&nbsp;four.
<p>Short.<div class="ad-box">Buy now</div><p>%s</p><blockquote>Said <i>so</i></blockquote></div><section class="comments"><p>%s</p></section></div>
<aside><p>%s</p></aside><form><p>Subscribe to everything</p></form><footer>&copy; me</footer><script>var t="</p>";</script></body></html>"""


def test_html_keeps_the_article_whole_and_nothing_else():
    body = "A long enough paragraph with many words in it. " * 8
    text = extract_text(PAGE % (body, "A reader comment that is long. " * 20, "Side story that is long. " * 20))
    assert text == "\n".join(["Head & tail", "One two three four.", "Short.", body.strip(), "Said so"])


BODY = "A long enough sentence of the body text. " * 12


@pytest.mark.parametrize(
    "page",
    [
        "<body class='has-sidebar'><div id=page class='no-sidebar'><article class='post has-comments'><header class='article-header'><h1>T</h1></header><p>%s</p></article></div></body>",
        "<body><main class='with-header'><h1>T</h1><p>%s</p></main></body>",
        "<body class=search><div class=hidden><h1>T</h1><p>%s</p></div></body>",
        "<body><div id=x><div class='article-header'><h1>T</h1></div><p>%s</p></div></body>",
    ],
)
def test_html_marks_do_not_empty_a_page(page):
    assert extract_text(page % BODY).split("\n") == ["T", BODY.strip()]


def test_html_marks_still_cut_what_is_outside():
    page = "<body><article><h1>T</h1><p>%s</p><div class='legal-text'>Own words</div><div class='share-buttons'>Share</div><div class='post-comments'>%s</div><div class='cookie-notice'>We use</div></article></body>"
    assert extract_text(page % (BODY, BODY * 3)).split("\n") == ["T", BODY.strip(), "Own words"]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<body><article><h1>T</h1><p>Lead.</p><div class=text><p>%s</p><p>%s</p></div><p>closing</p></article></body>", "T|Lead.|B|B|closing"),
        ("<body><div><h1>T</h1><div><p>%s</p><p>%s</p></div><ul><li>one<li>two</ul><p>closing</p></div><div><a href=x>More</a> <a href=y>Other</a></div></body>", "T|B|B|one|two|closing"),
        ("<body><main><h1>T</h1><article><p>%s</p><p>%s</p></article></main></body>", "T|B|B"),
        ("<body><article><p>Intro.</p><section><p>%s</p><p>%s</p></section><section><h2>S</h2><p>short second</p></section></article></body>", "Intro.|B|B|S|short second"),
    ],
)
def test_html_keeps_what_stands_around_the_body(page, want):
    assert extract_text(page % (BODY, BODY)).replace(BODY.strip(), "B").split("\n") == want.split("|")


def brute_article(html):
    """The blocks of the one article element of a page of the given table."""
    blocks = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", html or "", re.S).group(1))
    texts = (" ".join(unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


def test_html_of_the_whole_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = queries.op5_html_extraction(spark, sf).collect()
    assert len(out) == len(pages) and all(r.text == brute_article(pages[r.page_id]) and r.n_chars == len(r.text) for r in out)


def test_html_clusters_decide_where_names_say_nothing(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    right = {c: sum(extract_text(p, evidence=False, clusters=c) == brute_article(p) for p in pages) for c in (True, False)}
    assert right[True] > 0.75 * len(pages) and right[True] > right[False] + 0.15 * len(pages)
    menu = "".join(f"<li><a href={k}>Other page {k}</a>" for k in range(20))
    page = f"<body><div><a href=1>One</a></div><ul>{menu}</ul><div id=m><h1>T</h1><p>{BODY}</p><p>short</p></div><div>(c) Some site</div></body>"
    assert extract_text(page).split("\n") == ["T", BODY.strip(), "short"] != extract_text(page, clusters=False).split("\n")


@pytest.mark.parametrize(
    "page",
    [
        "<body class='no-sidebar'><article class='post-with-sidebar'><p>%s</p></article></body>",
        "<body><div class='elementor-widget'><article><p>%s</p></article></div></body>",
        "<body><form id='aspnetForm'><div><p>%s</p></div></form></body>",
        "<body><div class='elementor-widget'><p>%s</p></div><footer>Foot</footer></body>",
        "<html><head><title>Never closed<body><article><p>%s</p></article></body></html>",
    ],
)
def test_html_wrappers_do_not_empty_a_page(page):
    assert extract_text(page % BODY) == BODY.strip()


def test_html_keeps_headings_with_telling_ids_and_splits_of_widgets():
    assert extract_text("<article><h2 id='related-work'>Related work</h2><p>%s</p></article>" % BODY).startswith("Related work\n")
    assert extract_text("<body><div class='elementor-widget'><p>%s</p></div><div class='elementor-widget'><p>%s</p></div></body>" % (BODY, BODY)).count(BODY.strip()) == 2


SOURCES = "<h2>Sources</h2><ul>" + "".join(f"<li><a href={k}>Source {k}</a></li>" for k in range(5)) + "</ul>"
LISTED = "Sources|" + "|".join(f"Source {k}" for k in range(5))


@pytest.mark.parametrize(
    "page, want",
    [
        ("<body><div class='content-sidebar'><h1>T</h1>PPPP</div><footer>%s</footer></body>" % ("Imprint and more. " * 20), "T|B|B|B|B"),
        ("<body><form id='aspnetForm'><div>PPP</div></form><footer>%s</footer></body>" % ("Imprint and more. " * 30), "B|B|B"),
        ("<body><div class='layout-sidebar'><h1>T</h1>PPP</div><div>other words</div></body>", "T|B|B|B"),
        ("<body><article><h1>T</h1>P<div class='social-science'>PPP</div>P</article></body>", "T|B|B|B|B|B"),
        ("<body><article><h1>T</h1>P<p class='promotion'>%s</p>P</article></body>" % BODY, "T|B|B|B"),
        ("<body><article><h1>T</h1>P<h2 id='banner-ads'>Banner ads</h2>P</article></body>", "T|B|Banner ads|B"),
        (f"<body><article><h1>T</h1>P{SOURCES}</article></body>", f"T|B|{LISTED}"),
        (f"<body><div><h1>T</h1>PP{SOURCES}</div></body>", f"T|B|B|{LISTED}"),
        ("<body><article><h1>T</h1>PP<section id='responses'><p>%s</p></section></article></body>" % ("I agree with you all. " * 30), "T|B|B"),
        ("<body><article><h1>T</h1>PP<div class='advert'><p>%s</p></div>P</article></body>" % ("Buy this thing now. " * 30), "T|B|B|B"),
        ("<body><div class='ad'>%s</div><article><h1>Short</h1><p>Tiny.</p></article></body>" % ("Buy this thing now. " * 9), "Short|Tiny."),
        ("<body><div><div class='sidebar'><p>%s</p></div></div><div><h1>T</h1>PPPP</div></body>" % ("Side story text. " * 20), "T|B|B|B|B"),
        ("<body><div><h1>T</h1>PP<div class='newsletter-signup'><p>Get our letter every week.</p><form><input></form></div>P</div></body>", "T|B|B|B"),
        ("<article><h1>T</h1>P</article><a href='x", "T|B"),
        ("<article><p>x</p><!-- never ended P</article>", "x|never ended|B"),
        ("<p>a < b and c", "a < b and c"),
    ],
)
def test_html_names_yield_to_content_and_links_of_an_article_stay(page, want):
    assert extract_text(page.replace("P", f"<p>{BODY}</p>") if "PP" in page or ">P" in page or " P<" in page else page).replace(BODY.strip(), "B").split("\n") == want.split("|")


@pytest.mark.parametrize("piece", ["<a ", '<p x="', "<!--", "<!", "<![CDATA[", "<?", "</", "<p x='\">", "<!-- x > ", "<textarea>", "<title>", "&", "<p x=\">'"])
def test_html_is_linear_in_what_is_left_open(piece):
    began = time.time()
    assert extract_text("<p>hello</p>" + piece * ((1 << 20) // len(piece))).startswith("hello")
    assert time.time() - began < 15


def test_html_is_linear_in_depth_and_length():
    began = time.time()
    assert extract_text("<div>" * 100_000 + BODY + "</div>" * 100_000) == BODY.strip()
    assert len(extract_text("<p>some text<i>a</i>" * 50_000).split("\n")) == 50_000
    assert time.time() - began < 20


def test_html_of_awkward_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "just text &lt;b&gt;"), (4, "u", "<p><<<broken &#xZZ; <div"), (5, "u", "<p>" + "x " * 50_000), (5, "u", "<script>only</script>"), (None, "u", "<article><p>aé</p></article>")]
    out = html_extract(with_clashing_columns(spark.createDataFrame(rows, "page_id bigint, url string, html string"))).collect()
    assert len(out) == 7 and {r.page_id: r.text for r in out if r.page_id in (1, 2, 3)} == {1: "", 2: "", 3: "just text <b>"}
    assert [(r.text, r.n_chars) for r in out if r.page_id is None] == [("aé", 2)]
    assert html_extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").limit(0)).count() == 0


def test_warc_revisits_and_single_frames(spark, tmp_path):
    same_page, small = "<p>" + "z" * 200, "tiny"
    rows = [(5, "http://a\r\nb", same_page), (3, "u", same_page), (3, "u", same_page), (7, "u", small), (6, "u", small), (8, None, None), (9, "u", LONG), (None, "u", same_page)]
    pages = with_clashing_columns(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    path = f"file://{tmp_path}/warc"
    index = warc.write_archive(pages, path, frame_bytes=300, bundle_bytes=1000)
    out = warc.read_archive(index, path).collect()
    roles = sorted((r.page_id or -1, r.record_type, r.refers_to or 0, r.payload_bytes) for r in out)
    assert roles[1] == (3, "response", 0, 203) and roles[2][0] == 3
    assert roles[:1] + roles[3:] == [(-1, "revisit", 3, 203), (5, "revisit", 3, 203), (6, "response", 0, 4), (7, "response", 0, 4), (8, "response", 0, 0), (9, "response", 0, len(LONG))]
    assert {r.payload_digest for r in out if r.page_id == 9} == {sha(LONG)}
    for r in index.collect():
        head, payload = warc.read_record(path, r.bundle, r.frame, r.record_offset)
        assert head["WARC-Record-ID"] == f"<urn:uuid:{r.record_id}>" and "\n" not in head.get("WARC-Target-URI", "")
        if head["WARC-Type"] == "response":
            assert sha(payload) == head["WARC-Payload-Digest"].removeprefix("sha256:")
    filesystem, root = fs.FileSystem.from_uri(path)
    assert len(filesystem.get_file_info(fs.FileSelector(root))) > 1
    assert warc.warc_round_trip(spark, pages.limit(0)).count() == 0


def test_fingerprints_edits_and_order(spark):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(400)]
    rows = [(int(i * 7 % 101), " ".join(rng.choice(words, 120))) for i in range(60)] + [(500, "same words here"), (501, "same words here"), (502, None), (503, ""), (504, "é" * 9)]
    out = {r.doc_id: r for r in imatch.imatch(docs(spark, rows)).collect()}
    order = sorted(dict(rows))
    texts = dict(rows)
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        t, n = texts[a] or "", texts[b] or ""
        k = len(t) // 4
        assert out[a].n_chars == len(t) and out[a].edited_sha256 == sha(t[: len(t) - k] + n[:k])
    assert out[500].fingerprint == out[501].fingerprint and out[500].near_next == 1.0 and out[502].near_next == 1.0
    long = [out[i] for i in order if i < 200]
    assert np.mean([r.near_edited for r in long]) > 3 * np.mean([r.near_next for r in long])
    assert imatch.imatch(with_clashing_columns(awkward(spark))).count() == 10
    assert imatch.imatch(awkward(spark).limit(0)).count() == 0


def brute_prints(texts):
    """I-Match of all texts with Python numbers: the band, the subsets of both rungs, their hashes."""
    of = {i: set(re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), t.encode()))) for i, t in texts.items()}
    seen = Counter(w for ws in of.values() for w in ws)
    low, high = max(2.0, 0.001 * len(texts)), max(2.0, 0.2 * len(texts))
    band = {w for w, n in seen.items() if low <= n <= high}
    full = 2**64 - 1

    def mixed(x):
        for shift in (32, 29):
            x = (x ^ (x >> shift)) * int(imatch.MIX) & full
        return x ^ (x >> 32)

    seeds = [mixed(k * int(imatch.STEP) & full) for k in range(1, imatch.SUBSETS + 1)]

    def of_words(words):
        own = [int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in sorted(words & band)]
        if not own:
            return bytes([255]) + hashlib.sha256(b" ".join(sorted(words))).digest()[:8]
        rung = 0
        while 4**rung < len(own):
            rung += 1
        out = bytes([rung])
        for r in (rung, rung + 1):
            for s in seeds:
                picked = [h for h in own if r == 0 or mixed(h ^ s) >> (64 - 2 * r) == 0]
                total = sum(mixed((h + (k + 1) * int(imatch.STEP)) & full) for k, h in enumerate(picked)) & full
                out += ((mixed(total ^ s) >> 48 | 1) if picked else 0).to_bytes(2, "little")
        return out

    return of_words, of


def brute_likeness(a, b):
    if a == b:
        return 1.0
    if 255 in (a[0], b[0]) or abs(a[0] - b[0]) > 1:
        return 0.0
    at = lambda x, rung: [x[1 + 2 * (k + imatch.SUBSETS * (rung - x[0])) :][:2] for k in range(imatch.SUBSETS)]
    rung = max(a[0], b[0])
    both = [(x, y) for x, y in zip(at(a, rung), at(b, rung), strict=True) if x != b"\0\0" or y != b"\0\0"]
    return sum(x == y for x, y in both) / len(both) if both else 0.0


def test_fingerprints_of_the_whole_table_against_brute_force(spark, sf):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    of_words, words = brute_prints(rows)
    out = {r.doc_id: r for r in queries.op10_document_fingerprints(spark, sf).collect()}
    order = sorted(rows)
    assert sorted(out) == order
    fold = lambda t: set(re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), t.encode())))
    prints = {i: of_words(words[i]) for i in order}
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        k = len(rows[a]) // 4
        new = of_words(fold(rows[a][: len(rows[a]) - k] + rows[b][:k]))
        assert (out[a].fingerprint, out[a].edited_fingerprint) == (prints[a].hex(), new.hex())
        assert out[a].near_edited == pytest.approx(brute_likeness(prints[a], new)) and out[a].near_next == pytest.approx(brute_likeness(prints[a], prints[b]))


def test_fingerprint_ranges_do_not_change_the_result(spark):
    rows = [(i, f"alpha beta w{i % 5} gamma delta") for i in range(40)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(tuple, imatch.imatch(docs(spark, rows)).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]


def test_toxicity_on_held_out_rows(spark):
    docs_, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = queries.op8_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id")
    counts = {(r.toxic, r.predicted): r.n for r in scored.filter("held_out").groupBy("toxic", "predicted").agg(F.count(F.lit(1)).alias("n")).collect()}
    caught = counts.get((1, 1), 0) / (counts.get((1, 1), 0) + counts.get((1, 0), 0))
    spared = counts.get((0, 0), 0) / (counts.get((0, 0), 0) + counts.get((0, 1), 0))
    assert caught > 0.7 and spared > 0.93


def _speech(rng, n, words=300):
    return " ".join(f"w{k}" for k in rng.integers(0, words, n))


def test_toxicity_late_in_a_long_text_is_learned_and_caught(spark):
    rng = np.random.default_rng(7)
    rows = [(i, _speech(rng, 2500) + (" vile scum and wretched idiot" if i % 4 == 0 else "")) for i in range(160)]
    df, labels = docs(spark, rows), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)], "doc_id bigint, toxic int")
    out = toxicity.score(df, toxicity.train(df, labels)).collect()
    assert {r.doc_id for r in out if r.predicted} == {i for i in range(160) if i % 4 == 0}


def test_toxic_phrases_of_ordinary_words_are_learned(spark):
    rng = np.random.default_rng(8)
    phrases = [_speech(rng, 12, 4000) for _ in range(6)]
    rows = [(i, _speech(rng, 120, 4000) + (f" {phrases[i // 4 % 6]} {_speech(rng, 20, 4000)} {phrases[i // 4 % 6]} " if i % 4 == 0 else "") + _speech(rng, 60, 4000)) for i in range(400)]
    df, labels = docs(spark, rows), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id bigint, toxic int")
    model = toxicity.train(df, labels)
    got = {r.doc_id: r.predicted for r in toxicity.score(df, model).collect()}
    caught, wrong = np.mean([got[i] for i in got if i % 4 == 0]), np.mean([got[i] for i in got if i % 4])
    assert model.trained and caught > 0.6 and wrong < 0.2


def test_the_order_of_rows_does_not_change_the_dictionaries(spark):
    rng = np.random.default_rng(9)
    rows = [(bool(i % 4 == 0), i % 5, _speech(rng, 40).encode() + (b" vile scum" if i % 4 == 0 else b"")) for i in range(120)]
    shuffled = [rows[k] for k in rng.permutation(len(rows))] + rows[:10]
    assert toxicity.dictionaries(rows, 1) == toxicity.dictionaries(shuffled, 1)
    df = docs(spark, [(i, t.decode()) for i, (_, _, t) in enumerate(rows)])
    labels = spark.createDataFrame([(i, int(k)) for i, (k, _, _) in enumerate(rows)], "doc_id bigint, toxic int")
    assert toxicity.train(df, labels) == toxicity.train(df.repartition(7, "text"), labels.repartition(3))


def test_dictionaries_of_both_classes_are_trained_alike():
    rng = np.random.default_rng(10)
    rows = [(bool(i % 3 == 0), i % 5, (_speech(rng, 60) + (f" vile{i % 50}scum hate{i % 40}ful" if i % 3 == 0 else f" kind{i % 50}ness gentle{i % 40}man")).encode()) for i in range(900)]
    found = toxicity.dictionaries(rows, 0)
    assert set(found) == {-1, 0, 1, 2, 3, 4}
    base, clean, toxic = found[-1]
    assert len(base) <= toxicity.BASE_BYTES and len(clean) <= toxicity.OWN_BYTES and len(toxic) <= toxicity.OWN_BYTES
    assert b"scum" in toxic and b"ness" in clean and b"scum" not in clean + base and b"ness" not in toxic


def test_evidence_takes_windows_apart():
    model = toxicity.ToxicityModel(b"ordinary words are here and there " * 40, b" abominable ", 1.0)
    filler = b"ordinary words are here and there " * 6
    once = filler[:45] + b"abominable " + filler
    assert toxicity.evidence(once + once, model) > 1.5 * toxicity.evidence(once, model) > 0


def test_toxicity_of_awkward_rows_and_untrained_models(spark):
    df = with_clashing_columns(awkward(spark))
    none = toxicity.train(df, spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, toxic int"))
    out = toxicity.score(df, none).collect()
    assert len(out) == 10 and {(r.score, r.predicted) for r in out} == {(0.0, 0)}
    assert toxicity.drop_toxic(df, none).columns == df.columns and toxicity.drop_toxic(df, none).count() == 10
    assert sorted(map(str, toxicity.drop_toxic(df, none).collect())) == sorted(map(str, df.collect()))
    assert toxicity.score(df.limit(0), none).count() == toxicity.drop_toxic(df.limit(0), none).count() == 0
    model = toxicity.ToxicityModel(b"ordinary words are here and there " * 40, b" slur insult vile ", 1.0)
    hit = toxicity.score(docs(spark, [(1, "what a vile slur insult this is"), (2, "ordinary words are here"), (3, None)]), model)
    assert {r.doc_id: r.predicted for r in hit.collect()} == {1: 1, 2: 0, 3: 0}


def test_raking_meets_its_marginals(spark):
    cells = spark.createDataFrame([(s, l, t, 10 * (i + 1)) for i, (s, l, t) in enumerate((s, l, t) for s in "ab" for l in ("en", None) for t in "xy")], "source string, lang string, topic string, tokens bigint")
    targets = {d: mixing.power_targets(cells, d, 0.5) for d in mixing.DIMS}
    out = mixing.rake(cells, targets, rounds=25)
    for d in mixing.DIMS:
        want = {r[0]: r[1] for r in targets[d].collect()}
        got = {r[0]: r[1] for r in out.groupBy(d).agg(F.sum("raked")).collect()}
        assert got == pytest.approx(want, abs=1e-6)


def test_sampled_marginals_meet_the_targets_of_a_skewed_table(spark):
    rows = [(i, f"w{i} b c d e f g h" + (" | x" if i % 7 == 0 else "\nx") + " y" * 200, "en" if i % 5 else "de", "hot" if i % 3 else f"s{i % 11}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    tokens = mixing.tokens_of(F.col("text"))
    keyed = lambda d: d.select("source", "lang", mixing.topic_of(F.col("text")).alias("topic"), tokens.alias("tokens"))
    cells = keyed(df).groupBy(*mixing.DIMS).agg(F.sum("tokens").alias("tokens"))
    left = keyed(mixing.repeat_mix(df)).persist()
    total, everything = left.agg(F.sum("tokens")).first()[0], cells.agg(F.sum("tokens")).first()[0]
    assert abs(total / everything - mixing.BUDGET) < 0.02
    for d in mixing.DIMS:
        got = {r[0]: r[1] / total for r in left.groupBy(d).agg(F.sum("tokens")).collect()}
        want = {r[0]: r[1] for r in mixing.power_targets(cells, d, mixing.POWERS[d]).collect()}
        assert all(abs(got[k] - want[k]) < 0.01 for k in want), (d, got, want)


def test_mixing_of_awkward_rows(spark):
    df = with_clashing_columns(awkward(spark))
    out = mixing.mix(df).collect()
    assert len(out) == 10 and all(0 <= r.p <= 1 for r in out) and not any(r.selected for r in out if r.n_tokens == 0 and r.p == 0)
    assert mixing.mix(df.limit(0)).count() == 0
    left = mixing.sample_mix(df)
    assert left.columns == df.columns and left.count() == sum(r.selected for r in out)
    repeated = mixing.repeat_mix(df)
    assert repeated.columns == df.columns and repeated.count() == sum(r.copies for r in out)
    assert {str(r) for r in left.union(repeated).collect()} <= {str(r) for r in df.collect()}
    assert mixing.sample_mix(df.limit(0)).count() == mixing.repeat_mix(df.limit(0)).count() == 0


def test_mixing_to_given_targets(spark):
    rows = [(i, "w " * 10, "en" if i % 4 else "de", "hot" if i % 3 else "cold") for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    table = lambda dim, shares: spark.createDataFrame(list(shares.items()), f"{dim} string, target double")
    targets = {"source": table("source", {"hot": 0.5, "cold": 0.5}), "lang": table("lang", {"en": 0.4, "de": 0.6}), "topic": table("topic", {"short": 1.0})}
    left = mixing.repeat_mix(df, targets=targets, budget=1.0).collect()
    assert abs(len(left) - 1200) < 60
    for col, value, share in ((2, "en", 0.4), (3, "hot", 0.5)):
        assert abs(sum(r[col] == value for r in left) / len(left) - share) < 0.03
    out = mixing.mix(df, targets=targets, budget=1.0).collect()
    assert Counter(r.doc_id for r in left) == Counter({r.doc_id: r.copies for r in out if r.copies})
    cells = df.groupBy("source", "lang").agg((F.count(F.lit(1)) * 10).alias("tokens")).withColumn("topic", F.lit("short"))
    assert mixing.marginal_error(mixing.rake(cells, targets), targets) < 1e-4


def test_pipeline_stages_keep_columns_and_follow_their_operators(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, sf)
        collected = out.collect()
        rows = {r.doc_id: r for r in collected}
        before = {r.doc_id: r for r in df.collect()}
        assert set(rows) <= set(before)
        if name == "bpe":
            assert Counter(r.doc_id for r in collected) == Counter(r.doc_id for r in df.collect())
            assert all(sha(before[i].text or "") == r.decoded_sha256 for i, r in rows.items())
            break
        assert out.columns == df.columns and all(rows[i] == before[i] for i in rows)
        if name == "toxicity":
            model = toxicity.train(df, spark.read.parquet(f"{sf}/labels.parquet"))
            assert set(rows) == {r.doc_id for r in toxicity.score(df, model).filter("predicted = 0").collect()}
        if name == "exact dedup":
            seen = {}
            for i, r in before.items():
                key = re.sub("[ \t-\r]", "", r.text or "")
                seen[key] = min(seen.get(key, (1, 0)), (-len(r.text or ""), i))
            assert set(rows) == {i for _, i in seen.values()}
        if name == "minhash near-dedup":
            assert set(rows) == {i for i, (_, least) in brute_near([(i, r.text) for i, r in before.items()], 5, 80).items() if i == least}
        if name == "mixing":
            assert Counter(r.doc_id for r in collected) == Counter({r.doc_id: r.copies for r in mixing.mix(df).collect() if r.copies})
        df = spark.createDataFrame(collected, out.schema)
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_of_awkward_and_of_empty_tables(spark, tmp_path, empty):
    df = with_clashing_columns(awkward(spark))
    (df.limit(0) if empty else df).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(1, None, 0), (5, 1, 1), (7, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {r.doc_id: r.text or "" for r in df.collect() if r.doc_id is not None}
    assert all(sha(texts[r.doc_id]) == r.decoded_sha256 for r in out) and bool(out) is not empty
    assert {r.doc_id for r in out} <= {5, 7, 8}  # what is left after copies and near copies, but for texts without tokens
