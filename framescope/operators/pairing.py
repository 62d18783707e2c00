"""Pairing of reference and distorted frames: an equi-join on clip and frame number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("clip_id", "frame_no")
ENVELOPE = ("color_family", "bits", "dtype")


def _shape(planes: str):
    return F.transform(planes, lambda p: F.struct(p["height"].alias("h"), p["width"].alias("w")))


def mismatches(reference: DataFrame, distorted: DataFrame) -> DataFrame:
    """clip_id, frame_no, fault: frames without a partner, of another format or size than theirs, or standing more
    than once on a side (then paired with every one of the other). Reads metadata columns alone, no samples, and
    shuffles some tens of bytes a frame."""
    def side(df: DataFrame, name: str) -> DataFrame:
        shape = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in ENVELOPE), F.col("planes.height").cast("string"), F.col("planes.width").cast("string"))
        return df.groupBy(*KEYS).agg(F.min(shape).alias(f"{name}_low"), F.max(shape).alias(f"{name}_high"), F.count("*").alias(f"{name}_n"))

    both = side(reference, "r").join(side(distorted, "d"), list(KEYS), "full_outer")
    fault = (
        F.when(F.col("r_n").isNull(), "has no reference frame").when(F.col("d_n").isNull(), "has no distorted frame")
        .when((F.col("r_n") > 1) | (F.col("d_n") > 1), "stands more than once")
        .when((F.col("r_low") != F.col("d_low")) | (F.col("r_high") != F.col("d_high")), "differs in format or size")
    )
    return both.select(*KEYS, fault.alias("fault")).where("fault is not null")


def check(reference: DataFrame, distorted: DataFrame, told: int = 5) -> None:
    """Raise ValueError with the number of mismatches and the first of them, before any sample is read."""
    found = mismatches(reference, distorted)
    first = found.orderBy(*KEYS).limit(told + 1).collect()
    if first:
        listed = "; ".join(f"clip {r.clip_id} frame {r.frame_no} {r.fault}" for r in first[:told])
        raise ValueError(f"{found.count()} frames do not pair: {listed}{'; ...' if len(first) > told else ''}")


def pair(reference: DataFrame, distorted: DataFrame, on_mismatch: str = "error") -> DataFrame:
    """clip_id, frame_no, color_family, bits, dtype, ref, dist (arrays of planes).

    on_mismatch "check": `check` first, a job over metadata, then an inner join. "error": a frame without a partner, or of another format or size than its partner,
    fails the query when it is met (a full outer join; no extra job looks for them). "drop": such
    frames are left out. Other columns of distorted stay, so scores can be appended to them."""
    if on_mismatch not in ("error", "drop", "check"):
        raise ValueError(f"on_mismatch is 'error', 'drop' or 'check', not {on_mismatch!r}")
    if on_mismatch == "check":
        check(reference, distorted)
    r = reference.select(*KEYS, *(F.col(c).alias(f"__ref_{c}") for c in ENVELOPE), F.col("planes").alias("ref"))
    d = distorted.withColumnRenamed("planes", "dist")
    joined = r.join(d, list(KEYS), "full_outer" if on_mismatch == "error" else "inner")
    same = (F.array_compact(F.array(*[F.col(f"__ref_{c}").eqNullSafe(F.col(c)) for c in ENVELOPE])) == F.array(*[F.lit(True)] * len(ENVELOPE))) & (_shape("ref") == _shape("dist"))
    if on_mismatch == "drop":
        joined = joined.where(same)
    elif on_mismatch == "check":
        pass
    else:
        where = F.concat(F.lit("clip "), F.coalesce(F.col("clip_id"), F.lit("null")), F.lit(" frame "), F.coalesce(F.col("frame_no").cast("string"), F.lit("null")))
        fault = (
            F.when(F.col("ref").isNull(), F.concat(where, F.lit(" has no reference frame")))
            .when(F.col("dist").isNull(), F.concat(where, F.lit(" has no distorted frame")))
            .when(~same, F.concat(where, F.lit(" differs in format or size")))
        )
        joined = joined.withColumn("ref", F.when(fault.isNotNull(), F.raise_error(fault)).otherwise(F.col("ref")))
    return joined.drop(*(f"__ref_{c}" for c in ENVELOPE))
