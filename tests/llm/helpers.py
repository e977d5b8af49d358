"""Small document tables with the awkward rows every operator must take."""

import hashlib

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s1", len(t or "")) for i, t in rows], SCHEMA)


def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties, characters beyond the plane."""
    rows = [
        (1, "a quick test of the thing", "en", "s1", 5),
        (2, None, None, None, None),
        (3, "", "en", "s1", 0),
        (4, " \t\n\r", "de", "s2", 4),
        (5, LONG, "en", "s1", len(LONG)),
        (6, LONG, "en", "s1", len(LONG)),
        (7, "a  quick\ttest of the thing", "en", "s1", 5),
        (7, "a  quick\ttest of the thing", "en", "s1", 5),
        (None, "a quick test of the thing", "en", None, 5),
        (8, "é中\U0001f600 don't'll  x y", "fr", "s3", 9),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def with_clashing_columns(df):
    """Extra columns whose names the operators use themselves."""
    names = (
        "rep key tokens topic p h name row_id cid ratio spans tid score sig row id sha kept kept_id kept_sha nth copies value_ factor_ target_ sum_ raked moved "
        "_sha_ _nth_ _id _sha _source _lang _topic _copy _kept_id source_ lang_ topic_ ratio_ n_tokens fold toxic pair evidence bin hs level band pivot component "
        "anchor body start n edited_sha256 fingerprint kind part term url predicted"
    ).split()
    return df.withColumns({n: F.lit("x") for n in names})


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()
