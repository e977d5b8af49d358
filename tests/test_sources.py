"""Annotation objects read by byte ranges, digests of files, imports with a limit."""

import hashlib
import json
import random

import numpy as np
import pytest

from presentia.operators import quality as Q
from presentia.sources import annotations as src
from presentia.sources import json_entries as J

AWKWARD = {
    "plain/a.png": [1, 2, 3],
    'quote"d]': [],
    "back\\slash\\": [-5],
    'both\\"],{"x":[1]},': [7, 8],
    "comma,[]{}:": [0],
    "é中\U0001f600": [2**31 - 1, -(2**31)],
    "": [4],
    "line\nbreak\t": [5],
}
OTHERS = '"nested": [[1], 2], "object": {"a": [1, "]"]}, "number": 5, "text": "x]\\"", "float": [1.5], "large": [2147483648], "flag": [true]'


def object_text(seed=0):
    """All awkward entries with odd white space and escapes."""
    rng = random.Random(seed)
    blank = lambda: "".join(rng.choice([" ", "\n", "\t", ""]) for _ in range(2))
    entries = [f"{blank()}{json.dumps(k, ensure_ascii=bool(rng.getrandbits(1)))}{blank()}:{blank()}{json.dumps(v)}{blank()}" for k, v in AWKWARD.items()]
    return blank() + "{" + ",".join([*entries, OTHERS]) + blank() + "}" + blank()


def test_states_of_text_compose_wherever_it_is_cut():
    data = object_text(1).encode()
    whole = J.effects(data)
    for k in range(len(data) + 1):
        left, right = J.effects(data[:k]), J.effects(data[k:])
        state, depth = left[J.OUTSIDE]
        assert (right[state][0], depth + right[state][1]) == whole[J.OUTSIDE]
    plain, depth, inside, escaped = [], 0, False, False
    for c in data.decode("latin-1"):
        if inside:
            inside, escaped = (c != '"' or escaped), (c == "\\" and not escaped)
        elif c == '"':
            inside = True
        else:
            depth += (c in "[{") - (c in "]}")
        plain.append((inside, escaped, depth))
    for k in range(1, len(data) + 1):
        end, change = J.effects(data[:k])[0]
        assert (end != J.OUTSIDE, end == J.ESCAPED, change) == plain[k - 1]


def test_entries_are_those_of_the_object_wherever_it_is_cut():
    data = object_text(2).encode()
    want = json.loads(data)
    for k in range(len(data) + 1):
        left = J.Cutter()
        found = list(left.feed(data[:k]))
        assert all(whole for whole, _ in found)
        right = J.Cutter(left.state, left.depth, not left.cut)
        torn = left.carry
        for whole, entry in right.feed(data[k:]):
            found.append((True, entry if whole else torn + entry))
        got = [J.parsed(e) for _, e in found]
        assert [p for p, v, w in got] == list(want)
        assert {p: v for p, v, w in got if w is None} == AWKWARD


@pytest.mark.parametrize("size", [7, 40, 97, 1 << 20])
def test_objects_are_read_by_byte_ranges(spark, tmp_path, size):
    for k in (3, 4):
        (tmp_path / f"{k}.json").write_text(object_text(k))
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        rows = src.read_annotations(spark, str(tmp_path)).collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    good = sorted((r.path, list(r.vec)) for r in rows if r.problem is None)
    assert good == sorted(2 * [(p, v) for p, v in AWKWARD.items()])
    assert sorted(r.path for r in rows if r.problem == "bad_entry") == sorted(2 * ["nested", "object", "number", "text", "float", "large", "flag"])


@pytest.mark.parametrize("text", ["", "{}", " { } \n", "[1, 2]", "[1, 2]\n", '{"a": [1]', '{"a": [1]} {"b": [2]}', '{"a": [1]} x', 'x {"a": [1]}', '"a"', '{"a": [1]]}', "5"])
def test_what_is_no_object_or_an_empty_one_is_refused(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="annotations|object"):
        src.read_annotations(spark, str(tmp_path)).collect()


def test_bad_entries_and_lines_go_to_quarantine_with_a_reason(spark, tmp_path):
    vec = [1] * 40 + [0, 0, 0, 0]
    good = {f"Data/train/{k}/live/{k}.png": vec for k in range(1, 4)}
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "a.json").write_text(json.dumps(good)[:-1] + ', "Data/train/9/live/9.png": [1, "x"], oops: [1], }')
    (tmp_path / "l.json").write_text("\n".join([*(json.dumps({"path": p, "vec": v}) for p, v in good.items()), '{"path": "Data/train/9/li', '{"path": "Data/train/9/live/9.png"}', '{"path": 5, "vec": "x"}']))
    for annotations, bad in ((src.read_annotations(spark, str(tmp_path / "o")), 3), (src.read_annotations(spark, str(tmp_path / "l.json"), lines=True), 3)):
        kept, counts = Q.quarantine(Q.reasons(Q.decode(annotations)))
        assert {r.path for r in kept.collect()} == set(good) and {r.reason: r.n for r in counts.collect()} == {"bad_entry": bad}


def test_imports_keep_whole_subjects_up_to_a_limit(spark, tmp_path):
    vec = [1] * 40 + [0, 0, 0, 0]
    rows = [(f"Data/train/{s}/live/{k}.png", vec) for s in range(1, 6) for k in range(10)] + [("nowhere.png", vec)]
    a = spark.createDataFrame(rows, "path string, vec array<int>")
    counts = Q.import_annotations(a, f"{tmp_path}/all")
    assert {r.reason: r.n for r in counts.collect()} == {"bad_path": 1} and src.read_manifest(spark, f"{tmp_path}/all").count() == 50
    Q.import_annotations(a, f"{tmp_path}/some", limit=25)
    assert {r.subject for r in src.read_manifest(spark, f"{tmp_path}/some").collect()} == {"1", "2", "3"}


def test_files_of_any_size_have_digests(spark, tmp_path):
    big = np.random.default_rng(0).bytes(3 << 20)
    (tmp_path / "big").write_bytes(big)
    (tmp_path / "empty").write_bytes(b"")
    files = spark.createDataFrame([("big", f"file:{tmp_path}/big"), ("empty", f"file://{tmp_path}/empty"), ("gone", f"{tmp_path}/gone")], "name string, path string")
    found = {r.name: r.sha256 for r in src.file_digests(files, chunk=1 << 16).collect()}
    assert found == {"big": hashlib.sha256(big).hexdigest(), "empty": hashlib.sha256(b"").hexdigest(), "gone": None}
    expected = spark.createDataFrame([("big", found["big"]), ("empty", "0" * 64), ("gone", "1" * 64), ("never", "2" * 64), ("any", None)], "name string, sha256 string")
    status = {r.name: r.status for r in src.verify_checksums(src.file_digests(files), expected).collect()}
    assert status == {"big": "ok", "empty": "differs", "gone": "missing", "never": "missing", "any": "unchecked"}
    # The listing reads no content, so the size that a row can hold is no limit.
    before = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    try:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)
        listed = src.list_files(spark, str(tmp_path)).selectExpr("regexp_extract(path, '[^/]*$', 0) as name", "path")
        assert {r.name: r.sha256 for r in src.file_digests(listed).collect()}["big"] == found["big"]
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", before)
