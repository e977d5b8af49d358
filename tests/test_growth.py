"""Steps whose cost has to follow what they are given."""

import json

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from presentia.operators import galleries as G
from presentia.operators import trust as T
from presentia.queries import galleries, ingest, jobs
from presentia.queries.adapters import adapted
from presentia.streaming import faces as ST


def vector(k, dim=8):
    return [float(i == k) for i in range(dim)]


def test_an_embedding_is_matched_once_however_many_faces_have_it(spark, monkeypatch):
    faces = spark.range(600).select(F.col("id").alias("face_id"), F.when(F.col("id") % 5 < 4, F.col("id") % 3).alias("vec_id"), (F.col("id") % 2 * 0.9).alias("spoof_probability"))
    embeddings = spark.createDataFrame([(k, vector(k)) for k in range(5)], "vec_id bigint, v array<double>")
    gallery = spark.createDataFrame([("a", 0, vector(0)), ("b", 1, vector(1))], "name string, ordinal bigint, v array<double>")
    asked, identify = [], T.identify

    def seen(probes, *rest):
        asked.append(probes.count())
        return identify(probes, *rest)

    monkeypatch.setattr(T, "identify", seen)
    out = T.recognize(faces, embeddings, gallery, 0.5).collect()
    assert asked == [3] and len(out) == 600
    for r in out:
        known = r.face_id % 2 == 0 and r.vec_id is not None
        assert r.name == ({0: "a", 1: "b"}.get(r.vec_id) if known else None)
        assert r.similarity == (pytest.approx(1.0 if r.vec_id < 2 else 0.0) if known else None)
        assert r.status == ("SPOOF" if r.face_id % 2 else "TRUSTED" if r.name else "UNKNOWN")


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_similarities_that_round_alike_go_to_the_smallest_ordinal(spark, limit, monkeypatch):
    monkeypatch.setattr(G, "PIVOT_ROWS", 2)
    close = [("first", 3, [1.0, 1e-4]), ("later", 7, [1.0, 0.0]), ("far", 1, [0.0, 1.0]), ("other", 2, [-1.0, 0.0])]
    gallery = spark.createDataFrame(close, "name string, ordinal bigint, v array<double>")
    # The cosine of the third is 0.3599996, which is 0.36 in six places.
    probes = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [-0.3599996, -(1 - 0.3599996**2) ** 0.5])], "probe_id bigint, v array<double>")
    out = {r.probe_id: (r.name, r.similarity) for r in G.identify(probes, gallery, broadcast_bytes=limit).collect()}
    assert out[1] == ("first", pytest.approx(1.0)) and out[2] == ("far", pytest.approx(1.0)) and out[3] == ("other", pytest.approx(0.36, abs=1e-6))


def test_arrivals_of_several_files_are_one_batch_each(spark, sf, monkeypatch):
    one = sorted(map(tuple, jobs.h6_stream_capture(spark, sf).collect()))
    monkeypatch.setattr(jobs, "FILE_ROWS", 100)
    counted = adapted(spark, sf, "faces").count()
    monkeypatch.setattr(jobs, "LEAST_FILE_ROWS", 1)
    stream, still = jobs._stream(spark, sf)
    assert still.count() == counted and len(still.inputFiles()) > 8
    sizes = []
    q = stream.writeStream.foreachBatch(lambda b, k: sizes.append(b.count())).trigger(availableNow=True).start()
    q.awaitTermination()
    ts = sorted(r.ts for r in still.select(F.unix_micros("ts").alias("ts")).collect())
    cuts = [ts[0] + (ts[-1] - ts[0]) * k // 4 for k in (1, 2, 3)]
    assert sizes == [sum(sum(t >= c for c in cuts) == k for t in ts) for k in range(4)]
    assert sorted(map(tuple, jobs.h6_stream_capture(spark, sf).collect())) == one


def test_a_name_that_is_full_carries_no_vectors(spark):
    class Held:
        def __init__(self):
            self.rows = []

        def exists(self):
            return bool(self.rows)

        def get(self):
            return iter(self.rows)

        def appendValue(self, row):
            self.rows.append(row)

    state = ST._Enrolled(2, 0.98)
    state.vectors = Held()
    rows = pd.DataFrame([(1, k, k, vector(k % 4)) for k in range(6)], columns=["camera", "frame_id", "face_id", "v"])
    (out,) = state.handleInputRows(("a",), iter([rows]), None)
    assert out["kept"].tolist() == [True, True, False, False, False, False] and out["v"].notna().tolist() == out["kept"].tolist()


@pytest.mark.parametrize("few", [1, 1 << 30])
def test_ends_of_pairs_equal_all_pairs(spark, monkeypatch, few):
    """Copies, equal ordinals and ends that single precision cannot tell apart."""
    monkeypatch.setattr(G, "FEW_GENUINE", few)
    monkeypatch.setattr(G, "BLOCK", 50)
    monkeypatch.setattr(G, "COUNTED", 16)
    monkeypatch.setattr(G, "AT_ONCE", 16)
    monkeypatch.setattr(G, "TILE", 16)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(160, 6))
    v[40:60] = v[:20] + 1e-9 * rng.normal(size=(20, 6))
    v[60:64] = v[70]
    ids, names = np.arange(160), rng.integers(0, 5, 160)
    ids[100:110] = ids[:10]
    rows = [(f"n{names[k]}", int(ids[k]), v[k].tolist()) for k in range(160)]
    gallery = spark.createDataFrame(rows, "name string, ordinal bigint, v array<double>")
    unit = G._unit(v)
    sims = unit @ unit.T
    i, j = np.nonzero(ids[:, None] < ids[None, :])
    same, s = names[i] == names[j], sims[i, j]
    for made in (G.pair_ends, G.pair_counts):
        row = G.pair_stats(made(gallery)).first()
        assert (row.n_genuine, row.n_impostor) == (same.sum(), (~same).sum())
        want = (s[same].mean(), s[same].min(), s[~same].mean(), s[~same].max())
        assert (row.mean_genuine, row.min_genuine, row.mean_impostor, row.max_impostor) == pytest.approx(want, abs=1e-13)


def test_rows_of_rounded_pairs_are_short_in_column_files(spark, tmp_path):
    """Six places have a million steps: as they come, a similarity takes all of its 8 bytes and a row over 9."""
    rng = np.random.default_rng(5)
    rows = [(f"n{k % 9}", k, v.tolist()) for k, v in enumerate(rng.normal(size=(4800, 64)).astype(np.float32))]
    gallery = spark.createDataFrame(rows, "name string, ordinal bigint, v array<float>")
    G.pair_similarities(gallery, digits=6).write.parquet(str(tmp_path / "pairs"))
    n = 4800 * 4799 // 2
    assert spark.read.parquet(str(tmp_path / "pairs")).distinct().count() == n
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 6 * n


@pytest.mark.parametrize(("run", "digits"), [(1, 6), (4000, 6), (1 << 20, 3), (1 << 20, 15)])
def test_runs_of_pairs_hold_all_pairs(spark, monkeypatch, run, digits):
    """Equal ordinals, similarities that round to -0.0 and such that are not finite."""
    for name, value in (("SORTED", run), ("EMITTED", 64), ("BLOCK", 50), ("AT_ONCE", 16)):
        monkeypatch.setattr(G, name, value)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(160, 6))
    v[:20, 3:], v[20:40, :3], v[20:40, 3:] = 0.0, -1e-9, np.abs(v[20:40, 3:])
    v[:20] = np.abs(v[:20])
    v[70], v[71] = np.nan, 0.0
    ids = rng.permutation(160) - 80
    ids[100:110] = ids[:10]
    names = rng.integers(0, 5, 160)
    gallery = spark.createDataFrame([(f"n{names[k]}", int(ids[k]), v[k].tolist()) for k in range(160)], "name string, ordinal bigint, v array<double>")
    with np.errstate(all="ignore"):
        unit = G._unit(v)
        sims = unit @ unit.T
    i, j = np.nonzero(ids[:, None] < ids[None, :])
    s = sims[i, j]
    steps = np.copysign(np.floor(np.abs(s) * 10.0**digits + 0.5) / 10.0**digits, s)
    want = sorted((int(ids[a]), int(ids[b]), bool(names[a] == names[b]), repr(round(float(x), 12))) for a, b, x in zip(i, j, steps, strict=True))
    got = [(r.a, r.b, r.genuine, repr(round(r.similarity, 12))) for r in G.pair_similarities(gallery, digits=digits).collect()]
    assert sorted(got) == want
    assert digits > 3 or any(x[3] == "-0.0" for x in want) and any(x[3] == "nan" for x in want)
    linked = {(r.a, r.b) for r in G.pair_similarities(gallery, 0.5, digits=digits).collect()}
    assert linked == {(int(ids[a]), int(ids[b])) for a, b, x in zip(i, j, s, strict=True) if x >= 0.5}


def test_a_separable_gallery_needs_no_counts(spark, monkeypatch):
    rows = [("a", k, [1.0, 0.01 * k]) for k in range(3)] + [("b", 3 + k, [0.01 * k, 1.0]) for k in range(3)]
    gallery = spark.createDataFrame(rows, "name string, ordinal bigint, v array<double>")
    mixed = gallery.unionByName(spark.createDataFrame([("a", 9, [0.5, 1.0])], gallery.schema))
    want = G.calibrate_threshold(G.pair_counts(mixed)).first()
    assert G.calibrate_gallery(mixed).first() == want and not want.separable
    plain = G.calibrate_threshold(G.pair_counts(gallery)).first()
    monkeypatch.setattr(G, "pair_counts", None)
    row = G.calibrate_gallery(gallery).first()
    assert row.separable and (row.gap, row.threshold, row.errors) == (pytest.approx(plain.gap), pytest.approx(plain.threshold), 0)


def test_a_row_is_copied_to_a_bounded_number_of_blocks():
    assert [-(-n // G._block_rows(n)) for n in (1, 5000, 65_536, 205_128, 1_048_576)] == [1, 2, 16, 16, 16]


@pytest.mark.parametrize("query", [galleries.d18_calibrate_threshold, galleries.j5_calibrate_gallery])
def test_the_gap_of_a_query_is_one_of_rounded_similarities(spark, query, monkeypatch):
    turn = lambda c: [c, (1 - c * c) ** 0.5]
    # Genuine: 0.1000004, impostors at most 0.9000006 and less: unrounded the gap is -0.8000002, rounded -0.800001.
    rows = [("a", 1, turn(0.1000004)), ("a", 2, [1.0, 0.0]), ("b", 3, turn(0.9000006))]
    monkeypatch.setattr(galleries, "_whole", lambda *_: spark.createDataFrame(rows, "name string, ordinal bigint, v array<double>"))
    assert query(spark, "").first().gap == pytest.approx(-0.800001, abs=1e-9)


@pytest.mark.parametrize("sizes", [(), (0,), (1,), (2, 0, 3), (1, 1), (0, 4)])
def test_one_object_is_written_from_entries_in_any_order(sizes):
    entries = [f'"p{k}":[{k}]' for k in range(sum(sizes))][::-1]
    cuts = np.cumsum([0, *sizes])
    batches = [pa.RecordBatch.from_arrays([pa.array([e + "," for e in entries[a:b]], pa.string())], names=["value"]) for a, b in zip(cuts, cuts[1:], strict=False)]
    text = "\n".join(v for b in ingest._one_object(iter(batches)) for v in b.column("value").to_pylist())
    assert json.loads(text) == {f"p{k}": [k] for k in range(sum(sizes))}


def test_an_annotation_object_is_written_without_a_sort(spark, sf, monkeypatch):
    plans, text = [], DataFrameWriter.text

    def seen(writer, *args, **kwargs):
        plans.append(writer._df._jdf.queryExecution().optimizedPlan().toString())
        return text(writer, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "text", seen)
    assert ingest.a1_read_annotation_object(spark, sf).count() == adapted(spark, sf, "annotations").count()
    assert len(plans) == 1 and "Sort" not in plans[0]
