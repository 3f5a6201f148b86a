"""Licence detection and compatibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import license_values as V
from skein.functions.text import computed_once
from skein.operators.scan import matching, named, searchable, sql_text, with_keys


def confidence(pattern: str) -> float:
    return min(V.MAX_PATTERN_CONFIDENCE, V.BASE_CONFIDENCE + len(pattern) / V.LENGTH_UNIT)


def detect(documents: DataFrame) -> DataFrame:
    """Licence of each text: a known SPDX tag first, else the most specific pattern.

    The best match has the highest confidence, which depends on the pattern alone, and
    stands first in the table on a tie.
    """
    text = F.col("text")
    tag = F.regexp_extract(text, V.SPDX_TAG, 1)
    known = tag.isin(*[x.spdx_id for x in V.LICENSES])
    rows = [(place, x, p) for place, x in enumerate(V.LICENSES) for p in x.patterns]
    patterns = [p for *_, p in rows]
    values = [f"named_struct('confidence', {confidence(p)!r}D, 'place', {-place}, 'spdx_id', {sql_text(x.spdx_id)})" for place, x, p in rows]
    best = F.array_max(matching("text", patterns, values, named(patterns)))
    found = computed_once(with_keys(searchable(documents, "text"), patterns), __best=best)
    return found.select(
        *[c for c in documents.columns if c != "text"],
        F.when(known, tag).otherwise(F.coalesce(F.col("__best.spdx_id"), F.lit("UNKNOWN"))).alias("spdx_id"),
        F.when(known, 1.0).otherwise(F.coalesce(F.col("__best.confidence"), F.lit(0.0))).alias("confidence"),
        F.when(known, "spdx_header").otherwise("content").alias("found_in"),
    )


def _attribute(spdx: Column, field: str, default) -> Column:
    out = F
    for x in V.LICENSES:
        out = out.when(spdx == x.spdx_id, F.lit(getattr(x, field)))
    return out.otherwise(F.lit(default))


def metadata(detected: DataFrame) -> DataFrame:
    """Flags of the detected licence; an unknown one allows nothing."""
    spdx = F.col("spdx_id")
    return detected.select(
        "*",
        _attribute(spdx, "name", "Unknown License").alias("license_name"),
        _attribute(spdx, "category", "unknown").alias("category"),
        *[_attribute(spdx, f, d).alias(f) for f, d in (
            ("requires_attribution", True), ("commercial_allowed", False),
            ("modification_allowed", False), ("distribution_allowed", False))],
    )


def compatibility(detected: DataFrame, target: str) -> DataFrame:
    """Whether a licence suits the target, why, and what to do."""
    spdx = F.col("spdx_id")
    known = spdx.isin(*[x.spdx_id for x in V.LICENSES])
    name = _attribute(spdx, "name", "")
    category = _attribute(spdx, "category", "unknown")
    fits = _attribute(spdx, "compatible", False)
    reason = (
        F.when(~known, "Unknown license")
        .when(fits, F.concat(name, F.lit(f" is compatible with {target}")))
        .when(category == "strong_copyleft", F.concat(name, F.lit(" has strong copyleft requirements")))
        .when(category == "restricted", F.concat(name, F.lit(" has usage restrictions")))
        .when(category == "proprietary", "Proprietary license - not allowed")
        .otherwise("Unknown compatibility")
    )
    advice = (
        F.when(~known, "manual_review").when(fits, "auto_approve").when(category == "strong_copyleft", "review_required")
        .when(category.isin("restricted", "proprietary"), "reject").otherwise("manual_review")
    )
    return detected.withColumns({"valid_spdx": known, "compatible": fits, "reason": reason, "recommendation": advice})
