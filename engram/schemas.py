"""Table schemas, with defaults for columns that older files lack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

EVIDENCE = "struct<kind:string,source_id:string,url:string,turn_range:struct<start:int,end:int>,query:string,captured_at:timestamp,excerpt:string>"
LOG_EDGE = "struct<action:string,source_id:string,target_id:string,kind:string,weight:double>"

#: Columns of each table, and its key.
TABLES: dict[str, tuple[str, list[str]]] = {
    "interest_points": (
        "id string, agent_id string, name string, summary string, keywords array<string>, importance double, status string, subjective boolean, "
        "turn_range_start int, turn_range_end int, event_time timestamp, confidence double, reliability_status string, "
        f"evidence array<{EVIDENCE}>, freshness_level string, updated_at timestamp, ttl_days int, first_seen_at timestamp, "
        "last_seen_at timestamp, seen_count int, source_session_ids array<string>, wiki_worthy boolean",
        ["agent_id", "id"],
    ),
    "wiki_pages": (
        "id string, agent_id string, page_type string, title string, body_md string, status string, tags array<string>, sources array<string>, event_time timestamp, created_at timestamp, updated_at timestamp",
        ["agent_id", "id"],
    ),
    "edges": (
        "agent_id string, source_id string, target_id string, kind string, weight double, created_at timestamp",
        ["agent_id", "source_id", "target_id", "kind"],
    ),
    "pending_links": ("agent_id string, source_id string, target string, created_at timestamp", ["agent_id", "source_id", "target"]),
    "claims": (
        f"id string, page_id string, agent_id string, text string, status string, confidence double, evidence array<{EVIDENCE}>, freshness_level string, updated_at timestamp, ttl_days int",
        ["agent_id", "id"],
    ),
    "contradictions": (
        "id string, agent_id string, left_id string, right_id string, description string, status string, created_at timestamp",
        ["agent_id", "id"],
    ),
    "session_transcripts": (
        "session_id string, agent_id string, turn_count int, raw_turns string, received_at timestamp, session_date timestamp, processed_at timestamp",
        ["agent_id", "session_id"],
    ),
    "change_log": (
        f"id string, agent_id string, created_at timestamp, entity_kind string, entity_id string, title string, action string, edges array<{LOG_EDGE}>",
        ["agent_id", "id"],
    ),
    "usage": ("date string, input_tokens long, output_tokens long, cache_hit_tokens long, updated_at timestamp", ["date"]),
    "vectors": ("id string, agent_id string, kind string, embedding array<float>, cell string", ["agent_id", "kind", "id"]),
    "vector_cells": ("agent_id string, cell string, centre array<double>, radius double, n long", ["agent_id", "cell"]),
    "embedded": ("key string, v array<float>", ["key"]),
    "point_postings": ("agent_id string, gram string, kind string, id string, ids array<string>", ["agent_id", "gram", "kind", "id"]),
    "page_postings": ("agent_id string, gram string, kind string, id string, ids array<string>", ["agent_id", "gram", "kind", "id"]),
    "jobs": (
        "id string, agent_id string, session_id string, status string, error string, created_at timestamp, done_at timestamp",
        ["agent_id", "id"],
    ),
}

#: By what rows are sorted inside their files, so that scans for some values skip the rest.
SORTED = {"point_postings": ["agent_id", "gram"], "page_postings": ["agent_id", "gram"], "vectors": ["agent_id", "cell"]}

#: What a conflicting upsert does with a column, where it doesn't simply replace it.
KEPT: dict[str, dict[str, str]] = {
    "interest_points": {"first_seen_at": "keep"},
    "wiki_pages": {"created_at": "keep"},
    "contradictions": {"created_at": "keep"},
    "edges": {"created_at": "keep"},
    "usage": {"input_tokens": "add", "output_tokens": "add", "cache_hit_tokens": "add"},
    "session_transcripts": {"processed_at": "keep"},
}

#: Verdicts of outside models, as JSON.
VERDICTS = {
    "candidates": "array<struct<topic:string,reason:string,confidence:double,tags:array<string>,turn_range:array<int>,subjective:boolean,wiki_worthy:boolean>>",
    "merge": "struct<action:string,source_topics:array<string>,merged:struct<topic:string,name:string,reason:string,summary:string,confidence:double,tags:array<string>,turn_range:array<int>,subjective:boolean,wiki_worthy:boolean>>",
    "adjudication": "struct<decisions:array<struct<source_topic:string,action:string,target_id:string,merged:struct<topic:string,name:string,reason:string,summary:string,confidence:double,tags:array<string>,wiki_worthy:boolean>,"
    "updates:array<struct<target_id:string,merged:struct<topic:string,name:string,reason:string,summary:string,confidence:double,tags:array<string>,wiki_worthy:boolean>>>>>,contradictions:array<struct<left:string,right:string,description:string>>>",
    "audit": "struct<status:string,confidence:double,reason:string>",
    "review": "struct<summary:string,suggestions:array<struct<type:string,page_id:string,message:string>>>",
    "search": "struct<results:array<struct<title:string,url:string,snippet:string>>>",
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table][0])


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with exactly the table's columns and types: missing ones get '' (strings), an empty list or null; more are dropped."""
    have, out = set(df.columns), []
    for field in schema(table).fields:
        if field.name in have:
            out.append(F.col(field.name).cast(field.dataType).alias(field.name))
        elif field.dataType.typeName() == "string":
            out.append(F.lit("").alias(field.name))
        elif field.dataType.typeName() == "array":
            out.append(F.array().cast(field.dataType).alias(field.name))
        else:
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
    return df.select(*out)
