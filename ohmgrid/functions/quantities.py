"""Quantities with provenance, identifiers, slugs and digests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Provenances from the weakest to the strongest.
PROVENANCE = ("assumed", "derived", "configured", "imported")


def quantity(value: Column, unit: str, provenance: Column | str, note: Column | None = None) -> Column:
    """struct(value, unit, provenance, note)."""
    source = F.lit(provenance) if isinstance(provenance, str) else provenance
    return F.struct(
        value.cast("double").alias("value"), F.lit(unit).alias("unit"), source.alias("provenance"), (note if note is not None else F.lit(None).cast("string")).alias("note")
    )


def quantity_fault(q: Column) -> Column:
    """Why a quantity is refused, or null: it must be finite, of a known provenance, and say why if assumed."""
    value = q["value"]
    return (
        F.when(q.isNull(), F.lit(None).cast("string"))
        .when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), "not finite")
        .when(~q["provenance"].isin(*PROVENANCE), "unknown provenance")
        .when((q["provenance"] == "assumed") & (F.trim(F.coalesce(q["note"], F.lit(""))) == ""), "assumed without a note")
    )


def in_unit(q: Column, unit: str) -> Column:
    """The value if the unit is the expected one; another unit is an error, as units are never converted implicitly."""
    wrong = F.raise_error(F.concat(F.lit(f"expected {unit}, got "), q["unit"])).cast("double")
    return F.when(q.isNull(), F.lit(None).cast("double")).when(q["unit"] == unit, q["value"]).otherwise(wrong)


def is_assumed(q: Column) -> Column:
    return F.coalesce(q["provenance"] == "assumed", F.lit(False))


def provenance_rank(provenance: Column) -> Column:
    """0 for the weakest; null for an unknown one."""
    out = F.lit(None).cast("int")
    for k, name in enumerate(PROVENANCE):
        out = F.when(provenance == name, k).otherwise(out)
    return out


def weakest_provenance(provenance: Column) -> Column:
    """Aggregate: the weakest of a group; ``derived`` if the group has none."""
    least = F.min(provenance_rank(provenance))
    return F.coalesce(F.element_at(F.array(*[F.lit(p) for p in PROVENANCE]), least + 1), F.lit("derived"))


def slug(name: Column) -> Column:
    """Lower case, runs of other characters as one dash, none at the ends; ``unnamed`` if nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.coalesce(plain, F.lit("")) == "", "unnamed").otherwise(plain)


def _suffixed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Slugs of one family after another; ``tried`` holds how far the suffixes of each base have been given or passed over."""
    family, tried = None, {}

    def taken(name: str) -> bool:
        base, _, number = name.rpartition("-")
        return name in tried or (number.isdigit() and number[0] != "0" and 2 <= int(number) <= tried.get(base, 0))

    for frame in frames:
        out = []
        for own, base in zip(frame["__family"], frame["__slug"], strict=True):
            if own != family:
                family, tried = own, {}
            k = tried.get(base, 0) + 1
            while taken(base if k == 1 else f"{base}-{k}"):
                k += 1
            tried[base] = k
            out.append(base if k == 1 else f"{base}-{k}")
        frame["__slug"] = out
        yield frame


def unique_slugs(df: DataFrame, name: str, order: list[str], out: str = "slug", within: list[str] | None = None) -> DataFrame:
    """Adds a slug that no other row ``within`` has: in ``order``, each takes its own or the first free one of -2, -3, ...

    Only slugs of one family, the same but for numbers at the end, can meet.  A
    family is streamed through one task; the state is a number for each distinct slug.
    """
    based = df.withColumn("__slug", slug(F.col(name)))
    family = F.regexp_replace("__slug", "(-[1-9][0-9]*)+$", "")
    named = based.withColumn("__family", F.to_json(F.array(*[F.col(c).cast("string") for c in within or []], family)))
    dealt = named.repartition("__family").sortWithinPartitions("__family", *order)
    return dealt.mapInPandas(_suffixed, dealt.schema).drop("__family").withColumnRenamed("__slug", out)


def safe_label(name: Column, most: int = 48) -> Column:
    """An uploaded name with unusual characters as underscores and no dots, dashes or underscores at its ends; ``unnamed`` if nothing is left."""
    cleaned = F.regexp_replace(F.regexp_replace(F.trim(name), r"[^A-Za-z0-9._-]", "_"), r"^[._-]+|[._-]+$", "")
    return F.substring(F.when(F.coalesce(cleaned, F.lit("")) == "", "unnamed").otherwise(cleaned), 1, most)


# Parts of keys whose values are not logged, and what stands in their place.
SECRET_KEYS = ("password", "secret", "token", "api_key", "credential")
REDACTED = "***redacted***"


def redacted(context: Column) -> Column:
    """A map with the values of secret-looking keys hidden."""
    return F.transform_values(context, lambda k, v: F.when(F.lower(k).rlike("|".join(SECRET_KEYS)), REDACTED).otherwise(v))


def content_digest(text: Column) -> Column:
    return F.sha2(text.cast("string"), 256)


def analysis_signature(parts: list[Column]) -> Column:
    """SHA-256 over the parts as JSON; arrays have to be sorted by the caller, so that pick order does not matter."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{k:02d}") for k, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)


def job_id(signature: Column, created: Column) -> Column:
    """``job-`` and 16 hex digits of the digest of signature and creation time."""
    return F.concat(F.lit("job-"), F.substring(F.sha2(F.concat_ws(":", signature, created.cast("string")), 256), 1, 16))


def valid_job_id(name: Column) -> Column:
    return name.rlike("^job-[0-9a-f]{16}$")


def valid_digest(name: Column) -> Column:
    return name.rlike("^[0-9a-f]{64}$")
