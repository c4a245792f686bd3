"""Text expressions: normal forms, ids, truncation, wiki links, rendered lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_space(c: Column | str) -> Column:
    """Without white space (Unicode) at both ends."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def normalize_topic(c: Column | str) -> Column:
    """Trimmed, lower-case, each run of white space one space."""
    return F.lower(F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " ")))


def normalize_id(c: Column | str) -> Column:
    """Trimmed, lower-case, spaces and underscores as hyphens, one for one."""
    return F.translate(F.lower(trim_space(c)), " _", "--")


def hash_id(*parts: Column | str) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts joined by |. Null parts count as empty."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts]), 256), 1, 16)


def truncate_utf8(c: Column | str, n: int, mark: str = "...") -> Column:
    """Texts of at most n bytes stay; others are cut to the longest whole characters within n bytes, and marked. n <= 0: no limit."""
    c = _col(c)
    if n <= 0:
        return c
    raw = F.encode(c, "UTF-8")
    cut = [F.substring(raw, 1, n - k) for k in range(4) if k <= n]
    whole = F.coalesce(*[F.when(F.is_valid_utf8(x.cast("string")), x.cast("string")) for x in cut])
    return F.when(F.octet_length(raw) <= n, c).otherwise(F.concat(whole, F.lit(mark)))


def strip_fence(c: Column | str) -> Column:
    """Trimmed, without a leading ```json or ``` line mark and a trailing ```."""
    return trim_space(F.regexp_replace(F.regexp_replace(trim_space(c), r"^```(json)?", ""), r"```$", ""))


def candidate_text(topic: Column | str, reason: Column | str) -> Column:
    """What of a candidate is embedded: its topic, and its reason on the next line if there is one."""
    return F.when(F.coalesce(_col(reason), F.lit("")) == "", _col(topic)).otherwise(F.concat(_col(topic), F.lit("\n"), _col(reason)))


def entry_body(summary: Column | str, keywords: Column | str) -> Column:
    """What of a point is embedded: summary and keywords, by spaces."""
    return F.concat_ws(" ", _col(summary), F.array_join(_col(keywords), " "))


def wikilinks(body: Column | str) -> Column:
    """Distinct link targets in order: [[t]], [[t|label]] and [[t#section]] give t; embeds, [[#h]] and links in code don't count."""
    plain = F.regexp_replace(F.regexp_replace(_col(body), r"(?s)```.*?```", " "), r"`[^`\n]*`", " ")
    found = F.regexp_extract_all(plain, F.lit(r"(?<!!)\[\[([^\]|#]+)(?:#[^\]|]*)?(?:\|[^\]]*)?\]\]"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, trim_space), lambda t: t != ""))


def relink(body: Column | str, old: Column | str, new: Column | str) -> Column:
    """[[old]] as [[new]], literally."""
    wrap = lambda c: F.concat(F.lit("[["), _col(c), F.lit("]]"))
    return F.replace(_col(body), wrap(old), wrap(new))


def keyword_match(text: Column | str, query: Column | str) -> Column:
    """Lower-case LIKE %query%; % and _ in the query are wildcards. An empty query matches nothing."""
    q = _col(query)
    return (q != "") & F.like(F.lower(_col(text)), F.concat(F.lit("%"), F.lower(q), F.lit("%")))


def render_line(
    hit_id: Column,
    title: Column,
    kind: Column,
    event_time: Column,
    confidence: Column,
    status: Column,
    freshness: Column,
    note: Column,
    source: Column,
) -> Column:
    """One line of injected memory. Null confidence, freshness, note or source leave their part out."""
    blank = F.lit("")
    name = F.when(F.coalesce(title, blank) == "", hit_id).otherwise(title)
    return F.concat(
        F.lit("- ["), hit_id, F.lit("] "), name, F.lit(" ["), kind, F.lit("]"),
        F.coalesce(F.concat(F.lit(" (at "), F.date_format(event_time, "yyyy-MM-dd"), F.lit(")")), blank),
        F.when(confidence > 0, F.concat(F.lit(" (confidence "), F.format_string("%.2f", confidence), F.lit(", "), status, F.lit(")"))).otherwise(blank),
        F.when(~freshness.isin("", "unknown"), F.concat(F.lit(" freshness="), freshness)).otherwise(blank),
        F.when(note != "", F.concat(F.lit(" — "), note)).otherwise(blank),
        F.when(source != "", F.concat(F.lit(" [from: "), source, F.lit("]"))).otherwise(blank),
        F.lit("\n"),
    )


def wrap_memory(text: Column | str) -> Column:
    return F.concat(F.lit("<memory_context>\n"), _col(text), F.lit("\n</memory_context>"))


def describe_archived(name: Column, successor: Column) -> Column:
    """Log text of an archived entry, with what replaces it, if anything."""
    return F.concat_ws(" -> ", name, F.nullif(successor, F.lit("")))


def dialog_segment(turns: Column, start: Column, end: Column, user_bytes: int = 400, assistant_bytes: int = 300) -> Column:
    """Turns start..end (clamped; 0,0: nothing) of array<struct<role, content>>, each cut to its bytes, tool turns left out."""
    first, last = F.greatest(start, F.lit(0)), F.least(end, F.size(turns) - 1)
    part = F.when((last >= first) & ~((start == 0) & (end == 0)), F.slice(turns, first + 1, last - first + 1)).otherwise(F.slice(turns, 1, 0))
    said = F.filter(part, lambda t: t.role.isin("user", "assistant"))
    return F.array_join(
        F.transform(
            said,
            lambda t: F.concat(
                t.role,
                F.lit(": "),
                F.when(t.role == "user", truncate_utf8(t.content, user_bytes)).otherwise(truncate_utf8(t.content, assistant_bytes)),
            ),
        ),
        "\n",
    )
