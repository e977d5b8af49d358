"""Columns of annotation rows: subject, attack type, label errors, conditions, attributes, group keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the codes of a label vector mean.
SPOOF_ATTACKS = {0: "bona_fide", 1: "print", 2: "print", 3: "print", 4: "cutout", 5: "cutout", 6: "cutout", 7: "replay", 8: "replay", 9: "replay", 10: "mask_3d"}
SPOOF_NAMES = {0: "live", 1: "photo", 2: "poster", 3: "a4", 4: "face_mask", 5: "upper_body_mask", 6: "region_mask", 7: "pc", 8: "pad", 9: "phone", 10: "mask_3d"}
ILLUMINATIONS = {1: "normal", 2: "strong", 3: "back", 4: "dark"}
ENVIRONMENTS = {1: "indoor", 2: "outdoor"}
# Where the audited attributes stand in a vector.
AUDITED = {"Male": 20, "Young": 39, "Pale_Skin": 26, "Eyeglasses": 15, "Wearing_Hat": 35, "Heavy_Makeup": 18, "Wearing_Lipstick": 36, "Bald": 4, "Gray_Hair": 17, "No_Beard": 24}
VECTOR_LENGTH, SPOOF_AT, ILLUMINATION_AT, ENVIRONMENT_AT, FLAG_AT = 44, 40, 41, 42, 43


def _lookup(codes: dict[int, str], key: Column) -> Column:
    """The name of a code; null for codes without one."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in codes.items() for x in pair]), key)


def subject_from_path(path: Column) -> Column:
    """The all-digit directory above ``live`` or ``spoof``, else the first all-digit directory, else null."""
    parts = F.split(path, "/")
    digits = "^[0-9]+$"
    above = F.filter(F.transform(parts, lambda p, i: F.when(p.isin("live", "spoof") & (i > 0), F.get(parts, i - 1))), lambda p: F.coalesce(p.rlike(digits), F.lit(False)))
    first = F.filter(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.rlike(digits))
    return F.coalesce(F.get(above, F.lit(0)), F.get(first, F.lit(0)))


def attack_type(vec: Column) -> Column:
    return _lookup(SPOOF_ATTACKS, F.get(vec, F.lit(SPOOF_AT)))


def spoof_name(vec: Column) -> Column:
    return _lookup(SPOOF_NAMES, F.get(vec, F.lit(SPOOF_AT)))


def label_error(vec: Column) -> Column:
    """``short_vector``, ``unknown_code`` or ``flag_disagrees``, in that order; null for a good vector."""
    kind = attack_type(vec)
    return (
        F.when(F.coalesce(F.size(vec), F.lit(0)) < VECTOR_LENGTH, "short_vector")
        .when(kind.isNull(), "unknown_code")
        .when((F.get(vec, F.lit(FLAG_AT)) != 0) != (kind != "bona_fide"), "flag_disagrees")
    )


def conditions(vec: Column) -> Column:
    """Capture conditions of a spoof: spoof_type, illumination, environment; unknown codes are left out, live rows have none."""
    full = F.create_map(
        F.lit("spoof_type"), spoof_name(vec),
        F.lit("illumination"), _lookup(ILLUMINATIONS, F.get(vec, F.lit(ILLUMINATION_AT))),
        F.lit("environment"), _lookup(ENVIRONMENTS, F.get(vec, F.lit(ENVIRONMENT_AT))),
    )
    spoof = F.get(vec, F.lit(FLAG_AT)) != 0
    return F.map_filter(full, lambda k, v: v.isNotNull() & spoof)


def attributes(vec: Column) -> Column:
    """``attr:<name>`` -> yes or no for the audited attributes; present means above zero, absent is -1."""
    pairs = [x for name, at in AUDITED.items() for x in (F.lit(f"attr:{name}"), F.when(F.get(vec, F.lit(at)) > 0, "yes").otherwise("no"))]
    return F.create_map(*pairs)


def label(attack: Column) -> Column:
    """1 for attacks, 0 for bona fide."""
    return (attack != "bona_fide").cast("int")


def group_key(by: str) -> Column:
    """The unit a split keeps together: ``subject``, or ``session`` for subject/session."""
    if by == "subject":
        return F.col("subject")
    if by == "session":
        return F.concat_ws("/", "subject", "session")
    raise ValueError("split by subject or by session")
