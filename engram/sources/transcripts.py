"""Conversation transcripts of several clients, as rows session_id, idx, role, content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions.text import trim_space

TURN = "array<struct<role:string,content:string>>"
PARTS = "array<struct<type:string,text:string>>"


def wire_role(role: Column) -> Column:
    """user, assistant or tool, whatever the case; null for all others."""
    r = F.lower(role)
    return F.when(r.isin("user", "assistant"), r).when(r.isin("tool", "toolresult", "tool_result"), F.lit("tool"))


def chat_role(role: Column) -> Column:
    """Role towards a model: user unless assistant or tool."""
    return F.when(role.isin("assistant", "tool"), role).otherwise(F.lit("user"))


def parse_turns(raw: Column) -> Column:
    """array<struct<role, content>> of a JSON transcript: blank is empty, trimmed, empty turns and unknown roles dropped. Null if it's no JSON array."""
    read = F.when(trim_space(F.coalesce(raw, F.lit(""))) == "", F.array().cast(TURN)).otherwise(F.from_json(raw, TURN))
    clean = F.transform(read, lambda t: F.struct(wire_role(t.role).alias("role"), trim_space(t.content).alias("content")))
    return F.filter(clean, lambda t: t.role.isNotNull() & (F.coalesce(t.content, F.lit("")) != ""))


def explode_transcripts(df: DataFrame, keys: list[str], raw: str = "raw_turns", strict: bool = True) -> DataFrame:
    """keys, idx (from 0), role, content. strict: a transcript that is no JSON array fails the query; else it gives no rows."""
    turns = parse_turns(F.col(raw))
    if strict:
        turns = F.when(turns.isNull(), F.raise_error(F.concat(F.lit("no transcript: "), F.substring(raw, 1, 80)))).otherwise(turns)
    return df.select(*keys, F.posexplode(turns).alias("idx", "t")).select(*keys, "idx", "t.role", "t.content")


def _text_of(content: Column, kinds: Column | None = None) -> Column:
    """Text of a JSON content: a string, or the text parts of an array by line."""
    parts = F.from_json(content, PARTS)
    wanted = F.lit("text") if kinds is None else kinds
    joined = F.array_join(F.transform(F.filter(parts, lambda p: (p.type == wanted) & p.text.isNotNull()), lambda p: p.text), "\n")
    return trim_space(F.when(content.startswith("["), joined).otherwise(content))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines files as path, line_no (order within the file), value. A file is one unit of reading, so that lines keep their order."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", F.posexplode(F.split("value", "\n")).alias("line_no", "value"))


def newest_file(spark: SparkSession, path: str) -> DataFrame:
    """The *.jsonl file changed last, without *.events.jsonl."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime")
    return files.filter(
        F.col("path").endswith(".jsonl") & ~F.col("path").endswith(".events.jsonl"),
    ).agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def _numbered(df: DataFrame, session: list[str]) -> DataFrame:
    some = df.filter(F.col("role").isNotNull() & (F.coalesce("content", F.lit("")) != ""))
    grouped = some.groupBy(*session).agg(F.sort_array(F.collect_list(F.struct("line_no", "part", "role", "content"))).alias("ts"))
    return grouped.select(*session, F.posexplode("ts").alias("idx", "t")).select(*session, "idx", "t.role", "t.content")


def parse_message_lines(lines: DataFrame, session: list[str]) -> DataFrame:
    """Lines {"type": "user"|"assistant", "message": {role, content}}; bad lines are skipped."""
    read = lines.select(*session, "line_no", F.from_json("value", "struct<type:string,message:struct<role:string,content:string>>").alias("o"))
    ok = F.col("o.type").isin("user", "assistant") & F.col("o.message.role").isin("user", "assistant")
    return _numbered(
        read.filter(ok).select(
            *session,
            "line_no",
            F.lit(0).alias("part"),
            F.col("o.message.role").alias("role"),
            _text_of(F.col("o.message.content")).alias("content"),
        ),
        session,
    )


def parse_rollout_lines(lines: DataFrame, session: list[str]) -> DataFrame:
    """Lines {"type": "response_item", "payload": {"type": "message", role, content: [parts]}}; input_text of users, output_text of assistants."""
    read = lines.select(*session, "line_no", F.from_json("value", "struct<type:string,payload:struct<type:string,role:string,content:string>>").alias("o"))
    p = F.col("o.payload")
    ok = (F.col("o.type") == "response_item") & (p.type == "message") & p.role.isin("user", "assistant") & p.content.startswith("[")
    kind = F.when(p.role == "assistant", "output_text").otherwise("input_text")
    return _numbered(
        read.filter(ok).select(
            *session,
            "line_no",
            F.lit(0).alias("part"),
            p.role.alias("role"),
            _text_of(p.content, kind).alias("content"),
        ),
        session,
    )


def parse_plain_lines(lines: DataFrame, session: list[str]) -> DataFrame:
    """Lines {role, content}; users and assistants only."""
    read = lines.select(
        *session,
        "line_no",
        F.from_json("value", "struct<role:string,content:string>").alias("o"),
    ).filter(F.col("o.role").isin("user", "assistant"))
    return _numbered(
        read.select(
            *session,
            "line_no",
            F.lit(0).alias("part"),
            F.col("o.role").alias("role"),
            _text_of(F.col("o.content")).alias("content"),
        ),
        session,
    )


def parse_part_messages(messages: DataFrame, session: list[str]) -> DataFrame:
    """Messages {info: {role}, parts: [...]}, as column value: text parts joined; tool parts become tool_result turns."""
    kind = "struct<info:struct<role:string>,parts:array<struct<type:string,text:string,tool:string,state:struct<status:string,output:string,error:string>>>>"
    read = messages.select(*session, "line_no", F.from_json("value", kind).alias("o")).filter(F.col("o.info.role").isin("user", "assistant"))
    parts = F.coalesce(
        F.col("o.parts"),
        F.array().cast("array<struct<type:string,text:string,tool:string,state:struct<status:string,output:string,error:string>>>"),
    )
    said = F.array_join(F.transform(F.filter(parts, lambda p: (p.type == "text") & p.text.isNotNull()), lambda p: p.text), "\n")
    result = lambda p: trim_space(F.when(p.state.status == "completed", p.state.output).when(p.state.status == "error", p.state.error))
    tools = F.transform(
        F.filter(parts, lambda p: (p.type == "tool") & (F.coalesce(result(p), F.lit("")) != "")),
        lambda p: F.struct(
            F.lit("tool_result").alias("role"),
            F.concat(F.coalesce(p.tool, F.lit("tool")), F.lit(": "), result(p)).alias("content"),
        ),
    )
    turns = F.concat(F.array(F.struct(F.col("o.info.role").alias("role"), trim_space(said).alias("content"))), tools)
    return _numbered(
        read.select(*session, "line_no", F.posexplode(turns).alias("part", "t")).select(*session, "line_no", "part", "t.role", "t.content"),
        session,
    )


def parse_agent_messages(messages: DataFrame, session: list[str]) -> DataFrame:
    """Messages {role, content, toolName}, or wrapped as {"type": "message", "message": ...}; toolResult turns get the tool's name in front."""
    inner = "role:string,content:string,toolName:string"
    read = messages.select(*session, "line_no", F.from_json("value", f"struct<type:string,message:struct<{inner}>,{inner}>").alias("o"))
    field = lambda name: F.when(F.col("o.type") == "message", F.col(f"o.message.{name}")).otherwise(F.col(f"o.{name}"))
    text = _text_of(field("content"))
    role = F.when(field("role").isin("user", "assistant"), field("role")).when(field("role") == "toolResult", F.lit("tool_result"))
    named = F.when(
        (role == "tool_result") & (text != "") & (F.coalesce(field("toolName"), F.lit("")) != ""),
        F.concat(field("toolName"), F.lit(": "), text),
    ).otherwise(text)
    return _numbered(read.select(*session, "line_no", F.lit(0).alias("part"), role.alias("role"), named.alias("content")), session)


def parse_api_messages(messages: DataFrame, session: list[str]) -> DataFrame:
    """Messages {role, content} with any JSON as content, kept as its JSON text; user, assistant, tool and tool_result."""
    read = messages.select(
        *session,
        "line_no",
        F.from_json("value", "struct<role:string,content:string>").alias("o"),
    ).filter(F.col("o.role").isin("user", "assistant", "tool", "tool_result"))
    return _numbered(
        read.select(
            *session,
            "line_no",
            F.lit(0).alias("part"),
            F.col("o.role").alias("role"),
            trim_space(F.col("o.content")).alias("content"),
        ),
        session,
    )


def parse_block_messages(messages: DataFrame, session: list[str], owner: str) -> DataFrame:
    """Messages {role, content: [blocks], source}: texts of blocks, and of tool-result blocks one level down; user messages with such a
    block become tool_result; snapshots of the plugin `owner` are dropped."""
    kind = "struct<role:string,source:struct<kind:string,plugin:string>,content:array<struct<type:string,text:string,content:array<struct<type:string,text:string>>>>>"
    read = messages.select(*session, "line_no", F.from_json("value", kind).alias("o"))
    o = F.col("o")
    own = (F.coalesce(o.source.kind, F.lit("")) == "plugin") & (F.coalesce(o.source.plugin, F.lit("")) == owner)
    inner = lambda b: trim_space(F.array_join(F.transform(F.filter(b.content, lambda x: (x.type == "text") & x.text.isNotNull()), lambda x: x.text), "\n"))
    texts = F.transform(o.content, lambda b: F.when(b.type == "text", b.text).when(b.type == "tool-result", inner(b)))
    text = trim_space(F.array_join(F.filter(texts, lambda t: t.isNotNull()), "\n"))
    tool = F.coalesce(F.exists(o.content, lambda b: b.type == "tool-result"), F.lit(False))
    role = F.when((o.role == "user") & tool, F.lit("tool_result")).when(o.role.isin("user", "assistant"), o.role)
    return _numbered(read.filter(~own).select(*session, "line_no", F.lit(0).alias("part"), role.alias("role"), text.alias("content")), session)


def last_user_text(turns: DataFrame, session: list[str]) -> DataFrame:
    """The last user text that isn't blank, per session."""
    return turns.filter((F.col("role") == "user") & (trim_space("content") != "")).groupBy(*session).agg(F.max_by("content", "idx").alias("query"))


def push_fingerprint(turns: DataFrame, session: list[str]) -> DataFrame:
    """Number of turns and the last 200 characters of the last one, as count:tail, per session."""
    ends = turns.groupBy(*session).agg(F.count("*").alias("n"), F.max_by("content", "idx").alias("last"))
    return ends.select(*session, F.concat(F.col("n").cast("string"), F.lit(":"), F.substring("last", -200, 200)).alias("fingerprint"))


def parse_search_output(results: DataFrame, keys: list[str], limit: int = 5, snippet_bytes: int = 200) -> DataFrame:
    """Search answers (column output): JSON {results: [...]}, else markdown links with the next line as snippet, at most limit."""
    from engram.functions.text import truncate_utf8

    item = "struct<title:string,url:string,snippet:string>"
    read = F.from_json("output", f"struct<results:array<{item}>>").results
    is_json = F.try_parse_json("output").isNotNull() & trim_space("output").startswith("{")
    lines = F.split("output", "\n")
    link = r"\[([^\]]+)\]\(([^)]+)\)"
    found = F.transform(
        lines,
        lambda line, i: F.struct(
            F.regexp_extract(line, link, 1).alias("title"),
            F.regexp_extract(line, link, 2).alias("url"),
            truncate_utf8(trim_space(F.coalesce(F.get(lines, i + 1), F.lit(""))), snippet_bytes).alias("snippet"),
        ),
    )
    items = F.when(is_json, F.coalesce(read, F.array().cast(f"array<{item}>"))).otherwise(F.filter(found, lambda x: x.url != ""))
    items = F.slice(items, 1, limit)
    return results.select(*keys, F.posexplode(items).alias("pos", "i")).select(*keys, "pos", "i.title", "i.url", "i.snippet")
