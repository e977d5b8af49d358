"""Reading and writing annotation files, manifests, run summaries, artifacts and reports."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presentia.sources.json_entries import read_entries

SAMPLE = "path string, attack_type string, subject string, session string, instrument string, conditions map<string,string>"
SUMMARY = "run_id bigint, threshold double, split_by string, _corrupt_record string"


def read_annotations(spark: SparkSession, path: str, lines: bool = False, partitions: int | None = None) -> DataFrame:
    """(path, vec, problem) of annotation files: one JSON object of path -> vector each, or JSON lines of {path, vec}.

    Both are read in parallel by byte ranges, an object of any size too; see :mod:`presentia.sources.json_entries`.
    ``problem`` is null, or bad_entry where a line or an entry does not parse. An object that is none, does not end
    or is empty raises.
    """
    if lines:
        rows = spark.read.schema("path string, vec array<int>, _line string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line").json(path)
        bad = F.col("_line").isNotNull() | F.col("path").isNull() | F.col("vec").isNull()
        return rows.select("path", "vec", F.when(bad, "bad_entry").alias("problem"))
    rows = read_entries(spark, path)
    return rows.repartition(partitions) if partitions else rows


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a manifest; session defaults to ``default``, conditions to none."""
    rows = spark.read.schema(SAMPLE).json(path)
    return rows.withColumns({"session": F.coalesce("session", F.lit("default")), "conditions": F.coalesce("conditions", F.create_map().cast("map<string,string>"))})


def write_manifest(samples: DataFrame, path: str) -> None:
    """Samples as JSON lines; the output committer makes them appear at once."""
    samples.write.mode("errorifexists").json(path)


def append_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """Capture sessions accumulate."""
    return old.unionByName(new, allowMissingColumns=True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Asks the file system that owns the path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def resolve_image_root(samples: DataFrame, recorded: str, fallback: str) -> DataFrame:
    """``image`` paths below the recorded root if it still exists, else below the fallback."""
    root = recorded if path_exists(samples.sparkSession, recorded) else fallback
    return samples.withColumn("image", F.concat_ws("/", F.lit(root.rstrip("/")), "path"))


def missing_files(samples: DataFrame, listing: DataFrame) -> DataFrame:
    """Listed samples whose file does not exist; null paths are missing."""
    return samples.join(listing.select("path"), "path", "left_anti")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def file_digests(files: DataFrame, chunk: int = 8 << 20) -> DataFrame:
    """name, sha256 of files of any size from (name, path): tasks stream them in chunks, no content becomes a row.

    A file that is gone has a null digest. Paths are URIs of file systems that Arrow knows (file, hdfs, s3, gs, abfs).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, path in zip(b.column("name").to_pylist(), b.column("path").to_pylist(), strict=True):
                digest: str | None = None
                try:
                    filesystem, where = fs.FileSystem.from_uri(arrow_uri(path))
                    with filesystem.open_input_stream(where, compression=None) as stream:
                        found = hashlib.sha256()
                        while data := stream.read(chunk):
                            found.update(data)
                        digest = found.hexdigest()
                except FileNotFoundError:
                    pass
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([digest], pa.string())], names=["name", "sha256"])

    # Files may be large: each is a piece of work of its own.
    return files.select("name", "path").repartition(max(1, min(files.count(), 4096))).mapInArrow(run, "name string, sha256 string")


def arrow_uri(path: str) -> str:
    """A Hadoop URI as Arrow spells it."""
    scheme, colon, rest = path.partition(":")
    if not colon:
        return f"file://{path}"
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    return f"{scheme}://{rest}" if scheme == "file" and not rest.startswith("//") else f"{scheme}:{rest}"


def verify_checksums(digests: DataFrame, expected: DataFrame) -> DataFrame:
    """name, status: ok, differs, missing or unchecked (no expected digest), from two tables (name, sha256); see :func:`file_digests`."""
    both = expected.join(digests.select("name", F.col("sha256").alias("found")), "name", "left")
    status = F.when(F.col("sha256").isNull(), "unchecked").when(F.col("found").isNull(), "missing").when(F.col("sha256") == F.col("found"), "ok").otherwise("differs")
    return both.select("name", status.alias("status"))


def read_run_summary(spark: SparkSession, path: str) -> DataFrame:
    """run_id, threshold, split_by, verifiable: a corrupt or incomplete summary cannot be verified against."""
    rows = spark.read.schema(SUMMARY).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    good = F.col("_corrupt_record").isNull() & F.col("threshold").isNotNull()
    return rows.select("run_id", F.when(good, F.col("threshold")).alias("threshold"), F.when(good, F.col("split_by")).alias("split_by"), good.alias("verifiable"))


def write_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Report rows as JSON."""
    report.select(F.to_json(F.struct(*report.columns)).alias("value")).write.mode(mode).text(path)
