"""Tolerant decoding: enumerations, confidences, dates and lists that come from outside."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram.functions.text import _col, normalize_id, strip_fence, trim_space

# Enumerations and what stands for anything else.
EDGE_KINDS = ["related", "contradicts", "sequel", "references", "has_page"]
PAGE_TYPES, PAGE_TYPE_ELSE = ["entity", "concept", "synthesis", "source"], "concept"
PAGE_STATUS, PAGE_STATUS_ELSE = ["active", "superseded", "archived"], "active"
RELIABILITY, RELIABILITY_ELSE = ["supported", "contested", "unknown"], "unknown"
FRESHNESS, FRESHNESS_ELSE = ["fresh", "aging", "stale", "unknown"], "unknown"
CLAIM_STATUS, CLAIM_STATUS_ELSE = ["supported", "contested", "stale"], "supported"
EVIDENCE_KINDS = ["session", "page", "manual", "web"]


def enum(c: Column | str, allowed: list[str], default: str) -> Column:
    return F.when(_col(c).isin(allowed), _col(c)).otherwise(F.lit(default))


def clamp_confidence(c: Column | str) -> Column:
    """Outside (0, 1]: 0.5."""
    return F.when((_col(c) > 0) & (_col(c) <= 1), _col(c)).otherwise(F.lit(0.5))


def given_confidence(c: Column | str) -> Column:
    """Outside (0, 1]: 0, which means not given."""
    return F.when((_col(c) > 0) & (_col(c) <= 1), _col(c)).otherwise(F.lit(0.0))


def rfc3339(c: Column | str) -> Column:
    """Invalid: null."""
    return F.when(_col(c).rlike(r"^\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"), F.try_to_timestamp(_col(c)))


def event_time(session_date: Column | str, received_at: Column | str) -> Column:
    return F.coalesce(_col(session_date), _col(received_at))


def json_list(c: Column | str) -> Column:
    """A JSON array of strings, trimmed, blanks left out; anything else is empty."""
    read = F.coalesce(F.from_json(_col(c), "array<string>"), F.array().cast("array<string>"))
    return F.filter(F.transform(read, trim_space), lambda s: s.isNotNull() & (s != ""))


def edge_list(c: Column | str) -> Column:
    """A JSON array of {target_id, kind}: normalised; those without both are left out."""
    read = F.coalesce(F.from_json(strip_fence(c), "array<struct<target_id:string,kind:string>>"), F.array().cast("array<struct<target_id:string,kind:string>>"))
    clean = F.transform(read, lambda e: F.struct(normalize_id(e.target_id).alias("target_id"), F.lower(trim_space(e.kind)).alias("kind")))
    return F.filter(clean, lambda e: (F.coalesce(e.target_id, F.lit("")) != "") & (F.coalesce(e.kind, F.lit("")) != ""))


def claim_list(c: Column | str) -> Column:
    """A JSON array of {text, status, confidence}: blank texts left out, status and confidence coerced."""
    kind = "array<struct<text:string,status:string,confidence:double>>"
    read = F.coalesce(F.from_json(strip_fence(c), kind), F.array().cast(kind))
    some = F.filter(read, lambda x: F.coalesce(trim_space(x.text), F.lit("")) != "")
    return F.transform(
        some,
        lambda x: F.struct(
            x.text.alias("text"),
            enum(x.status, CLAIM_STATUS, CLAIM_STATUS_ELSE).alias("status"),
            clamp_confidence(x.confidence).alias("confidence"),
        ),
    )


def cap_list(c: Column | str, n: int = 10) -> Column:
    return F.slice(_col(c), 1, n)


def worthy(c: Column | str) -> Column:
    """Null means not judged, which counts as worthy."""
    return F.coalesce(_col(c), F.lit(True))
