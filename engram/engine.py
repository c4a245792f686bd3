"""The engine: what clients call, over a store of tables."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import reduce
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.config import Config
from engram.functions import coerce as C
from engram.functions.text import candidate_text, hash_id, normalize_id, strip_fence, wrap_memory
from engram.operators import graph as G
from engram.operators import keyword_index as Y
from engram.operators import lookups as L
from engram.operators import vector_index as I
from engram.operators import vectors as K
from engram.operators import results as V
from engram.operators import windows as W
from engram.operators.view import Remembered, related_pages
from engram.plans import consolidate as P
from engram.plans import process as Z
from engram.plans import recall as R
from engram.plans import session as S
from engram.plans.worker import Failures, run_isolated
from engram.schemas import VERDICTS
from engram.sources import providers
from engram.sources.scratch import scratch
from engram.sources.store import Snapshot, Store, Transaction, add_edge_pairs, retain_newest
from engram.sources.transcripts import explode_transcripts

T = TypeVar("T")


class Engine:
    """All reads take many queries and agents at once; `now` is passed in, so that plans stay deterministic."""

    def __init__(
        self,
        spark: SparkSession,
        config: Config | None = None,
        embedder: Callable[[], providers.EmbedProvider] | None = None,
        chat: Callable[[], providers.ChatProvider] | None = None,
    ):
        self.spark, self.config = spark, config or Config()
        self.store, self.chat = Store(spark, self.config.root), chat
        self.embedder = embedder
        self.recalled = Remembered(512, 30.0, time.monotonic)

    # Reads

    def _namespaces(self, readers: DataFrame, at: Snapshot) -> DataFrame:
        """What readers (reader) see: reader, ns, ord, their own first. In mode all these are all agents that have written anything, which is a list
        per reader by definition."""
        mode = self.config.namespaces.mode
        if mode == "all":
            every = L.list_agents(at.read("interest_points"), at.read("wiki_pages")).select(F.col("agent_id").alias("ns"))
            listed = every.agg(F.sort_array(F.collect_set("ns")).alias("all"))
            shared = readers.join(listed, F.lit(True)).select("reader", F.explode("all").alias("ns"), F.lit(1).alias("ord"))
        else:
            rows = [(a, ns, i + 1) for a, spaces in self.config.namespaces.visible.items() for i, ns in enumerate(spaces)] if mode == "custom" else []
            shared = self.spark.createDataFrame(rows, "reader string, ns string, ord int")
        return R.visible_namespaces(readers, shared)

    def _visible(self, queries: DataFrame, at: Snapshot) -> DataFrame:
        """queries by the namespaces their agent sees: q, reader, agent_id (namespace), ns_ord, text."""
        seen = self._namespaces(queries.select(F.col("agent_id").alias("reader")).distinct(), at)
        seen = seen.select("reader", F.col("ns").alias("agent_id"), F.col("ord").alias("ns_ord"))
        return queries.withColumnRenamed("agent_id", "reader").join(seen, "reader")

    def retrieve(self, queries: DataFrame, k: int, at: Snapshot | None = None) -> DataFrame:
        """queries: q, agent_id, text and, with an embedder, their vectors v. The first tier that finds anything: vectors, then keywords. The vector tier is there if the store is found to hold
        vectors; queries of another dimension go to the keywords."""
        at = at or self.store.snapshot()
        q = self._visible(queries, at)
        words = Y.search(at, q.select("q", "agent_id", "text"), k)
        tiers = [words]
        if "v" in queries.columns and (dimension := I.probe(at)):
            asked = q.filter(F.size("v") == dimension).select(F.col("q").cast("string").alias("id"), "agent_id", F.xxhash64("q").alias("ord"), "v")
            near = I.nearest(at, asked, k)
            tiers = [near.select("q", "agent_id", "id", "kind", "score", F.col("rank").alias("place")), words]
        hits = R.cascade(*tiers)
        return hits.join(q.select("q", "agent_id", "reader", "ns_ord"), ["q", "agent_id"])

    def recall(
        self,
        queries: DataFrame,
        now: Column,
        after: Column | None = None,
        before: Column | None = None,
        days: int = 0,
        include_wiki: bool = False,
    ) -> DataFrame:
        """One text per query: q, text. A client that only writes (mode input) is told nothing."""
        c = self.config.recall
        if self.config.mode == "input":
            return self.spark.createDataFrame([], "q string, text string")
        at = self.store.snapshot()
        points, pages, edges, claims = (at.read(t) for t in ("interest_points", "wiki_pages", "edges", "claims"))
        wiki = self.config.wiki_enabled and (include_wiki or c.include_wiki)
        hits = R.event_times(R.rerank(self.retrieve(queries, c.top_k, at), c.top_k), points, pages)
        kept = R.filter_hits(hits, c.min_score, wiki, after, before, now, days)
        moved = R.substitute(kept, edges, points, pages).drop("id", "kind").withColumnsRenamed({"new_id": "id", "new_kind": "kind"})
        graded = R.regroup_by_agent(R.grade(moved, points, pages, claims))
        return R.recall_text(graded, own=F.col("reader")).withColumn("text", wrap_memory("text"))

    def recall_one(self, agent: str, text: str, now: Column, after: str = "", before: str = "", days: int = 0) -> str:
        """The text of one query. It is kept for a while under all that it depends on; a write of this engine forgets what was kept."""
        c = self.config.recall
        at = lambda t: F.lit(t).cast("timestamp") if t else None
        queries = self.spark.createDataFrame([("q", agent, text)], "q string, agent_id string, text string")
        if self.embedder:
            queries = self.embed(queries)

        def make() -> str:
            row = self.recall(queries, now, at(after), at(before), days).first()
            return row.text if row else ""

        return self.recalled.get((agent, text, c.top_k, c.include_wiki, c.min_score, after, before, days), make)

    def search(self, queries: DataFrame) -> DataFrame:
        """Whole documents per query: q, rank, score, the columns of entry_results, and links; archived ones are replaced by what follows them."""
        k, at = self.config.search.top_k, self.store.snapshot()
        points, pages, edges = (at.read(t) for t in ("interest_points", "wiki_pages", "edges"))
        hits = R.rerank(self.retrieve(queries, k, at), k)
        moved = R.substitute(hits, edges, points, pages).drop("id", "kind").withColumnsRenamed({"new_id": "id", "new_kind": "kind"})
        found = self._results(self.config.search.max_body_len, at)
        rows = moved.drop("status").join(found, ["agent_id", "id", "kind"])
        rows = V.with_edges(rows, edges, points, pages)
        return rows if self.config.wiki_enabled else rows.filter("kind != 'wiki_page'")

    def _results(self, max_body: int, at: Snapshot) -> DataFrame:
        return V.entry_results(at.read("interest_points"), at.read("wiki_pages"), at.read("claims"), max_body)

    def get(self, ids: DataFrame) -> DataFrame:
        """Entries by id (agent_id, id), each from the first namespace that its agent sees it in: agent_id, id, namespace, the columns of entry_results, links,
        and for archived ones, which are returned as they are, the replacement (struct)."""
        at = self.store.snapshot()
        points, pages, edges = (at.read(t) for t in ("interest_points", "wiki_pages", "edges"))
        asked = ids.select(F.col("agent_id").alias("reader"), "id").distinct()
        seen = self._namespaces(asked.select("reader").distinct(), at)
        found = scratch(self.spark)(V.first_visible(self._results(self.config.search.max_body_len, at), seen, asked), "found")
        linked = V.with_edges(found, edges, points, pages)
        gone = found.filter("status not in ('', 'active')").select("agent_id", "id")
        after = V.replacement_refs(gone, edges, points, pages)
        return linked.join(after, ["agent_id", "id"], "left").withColumnsRenamed({"agent_id": "namespace", "reader": "agent_id"})

    def memory_search(self, queries: DataFrame | None = None, ids: DataFrame | None = None) -> DataFrame:
        """By id if ids are given, else by query."""
        return self.get(ids) if ids is not None else self.search(queries)

    def memory_logs(self, agent: str, limit: int = 10, offset: int = 0) -> DataFrame:
        return L.log_page(self.store.read("change_log").filter(F.col("agent_id") == agent), limit, offset)

    def wiki_query(self, agent: str, text: str, top_k: int = 3) -> DataFrame:
        """Pages near the text by vectors; by keywords if there is no embedder, or nothing is near."""
        at, k = self.store.snapshot(), min(max(top_k, 1), 10)
        pages = at.read("wiki_pages").filter(F.col("agent_id") == agent)
        if self.embedder and I.probe(at):
            asked = self.embed(self.spark.createDataFrame([("q", agent, text)], "id string, agent_id string, text string"))
            near = I.nearest(at, asked.select("id", "agent_id", F.lit(0).cast("long").alias("ord"), "v"), k, kind="wiki_page")
            found = scratch(self.spark)(pages.join(near.select("agent_id", "id", "rank"), ["agent_id", "id"]), "near_pages")
            if found.limit(1).count():
                return found.orderBy("rank").drop("rank")
        return L.search_pages(pages, text, k)

    def ip_query(self, agent: str, text: str, top_k: int = 3) -> DataFrame:
        """Points with the pages that they have, as text."""
        found = L.search_points(self.store.read("interest_points").filter(F.col("agent_id") == agent), text, min(max(top_k, 1), 10))
        pages = L.points_pages(self.store.read("edges"), self.store.read("wiki_pages"))
        refs = pages.groupBy("agent_id", F.col("point_id").alias("id")).agg(
            F.sort_array(F.collect_list(F.concat("page_id", F.lit(" ("), F.coalesce("title", F.lit("")), F.lit(")")))).alias("pages"),
        )
        return found.join(refs, ["agent_id", "id"], "left")

    def interest_points(self, agent: str) -> DataFrame:
        return self.store.read("interest_points").filter(F.col("agent_id") == agent).orderBy(F.col("importance").desc(), "id")

    def wiki_pages(self, agent: str, page_type: str = "") -> DataFrame:
        pages = self.store.read("wiki_pages").filter(F.col("agent_id") == agent)
        return L.attach_claims(pages.filter(F.col("page_type") == page_type) if page_type else pages, self.store.read("claims"))

    def pending_links(self, agent: str) -> DataFrame:
        return self.store.read("pending_links").filter(F.col("agent_id") == agent).orderBy(F.col("created_at").desc(), "source_id", "target")

    def wiki_tags(self, agent: str) -> DataFrame:
        return L.list_tags(self.store.read("wiki_pages").filter(F.col("agent_id") == agent)).orderBy("place")

    def graph(self, agent: str) -> tuple[DataFrame, DataFrame]:
        mine = lambda t: self.store.read(t).filter(F.col("agent_id") == agent)
        nodes = G.graph_nodes(mine("interest_points"), mine("wiki_pages"))
        return nodes, G.graph_links(mine("edges"), nodes)

    def stats(self) -> DataFrame:
        return L.agent_stats({t: self.store.read(t) for t in ("interest_points", "wiki_pages", "contradictions")})

    def usage(self, since: str = "") -> DataFrame:
        return self.store.read("usage").filter(F.col("date") >= since).orderBy("date")

    def next_unprocessed(self, agent: str) -> DataFrame:
        return self.store.read("session_transcripts").filter(
            (F.col("agent_id") == agent) & F.col("processed_at").isNull(),
        ).orderBy("received_at", "session_id").limit(1)

    def contradictions(self, agent: str) -> DataFrame:
        return self.store.read("contradictions").filter(F.col("agent_id") == agent).orderBy("created_at", "id")

    def edges(self, agent: str) -> DataFrame:
        return self.store.read("edges").filter(F.col("agent_id") == agent).orderBy(F.col("weight").desc(), "source_id", "target_id", "kind")

    def review_pages(self, agent: str) -> DataFrame:
        """What a reviewer sees of a page."""
        return V.review_pages(self.store.read("wiki_pages").filter(F.col("agent_id") == agent)).drop("agent_id")

    def verify_claims(self, claims: DataFrame, evidence: DataFrame) -> DataFrame:
        """claims (any keys, text) with status, confidence and reason: a model's verdict on each text with its evidence (text, snippet). Without evidence, or
        where the answer fails, unknown."""
        read = F.from_json(strip_fence("answer"), VERDICTS["audit"])
        told = evidence.groupBy("text").agg(F.array_join(F.sort_array(F.collect_list("snippet")), "\n").alias("found"))
        asked = claims.select("text").distinct().join(told, "text")
        prompt = F.concat(
            F.lit(
                "Does the evidence bear this out? Answer as JSON with status (supported, contested, unknown), confidence and reason.\nClaim: ",
            ),
            "text",
            F.lit("\nEvidence:\n"),
            "found",
        )
        answers = self.ask(asked.select("text", prompt.alias("prompt"))).select("text", read.alias("a")) if self.chat else asked.select(
            "text",
            F.lit(None).cast(VERDICTS["audit"]).alias("a"),
        )
        status = C.enum(F.col("a.status"), C.RELIABILITY, C.RELIABILITY_ELSE)
        out = claims.join(answers, "text", "left")
        return out.select(
            *claims.columns,
            status.alias("status"),
            C.given_confidence(F.coalesce("a.confidence", F.lit(0.0))).alias("confidence"),
            F.coalesce("a.reason", F.lit("")).alias("reason"),
        )

    def review(self, drafts: DataFrame, limit: int = 5) -> DataFrame:
        """drafts (q, agent_id, id, draft) with summary and suggestions (type, page_id, message) of a model that sees the draft beside the page it
        names and the pages its words find. Empty where the answer fails."""
        pages = self.store.read("wiki_pages")
        hits = R.full_text_fallback(
            drafts.select(F.col("q"), "agent_id", F.col("draft").alias("text")),
            self.store.read("interest_points").limit(0),
            pages,
            limit,
        )
        near = related_pages(drafts.select("q", "agent_id", "id"), hits.withColumnRenamed("place", "rank"), pages, limit)
        shown = near.join(drafts.select("q", "agent_id"), "q").join(pages.select("agent_id", "id", "title", "body_md"), ["agent_id", "id"])
        told = shown.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("place", F.concat_ws("\n", "id", "title", "body_md").alias("t")))).alias("x"))
        seen = F.coalesce(F.array_join(F.transform("x", lambda p: p.t), "\n---\n"), F.lit(""))
        prompt = F.concat(
            F.lit("Review this draft beside these pages; answer as JSON with summary and suggestions (type, page_id, message).\n"),
            "draft",
            F.lit("\n---\n"),
            seen,
        )
        answers = self.ask(drafts.join(told, "q", "left").select("q", prompt.alias("prompt"))).select(
            "q",
            F.from_json(strip_fence("answer"), VERDICTS["review"]).alias("a"),
        )
        out = drafts.join(answers, "q", "left")
        none = F.array().cast("array<struct<type:string,page_id:string,message:string>>")
        return out.select(*drafts.columns, F.coalesce("a.summary", F.lit("")).alias("summary"), F.coalesce("a.suggestions", none).alias("suggestions"))

    def job(self, jobs: DataFrame, agent: str, job_id: str) -> DataFrame:
        """The job of that id, if it is the agent's own."""
        return V.own_jobs(self.spark.createDataFrame([(agent, job_id)], "agent_id string, id string"), jobs)

    def fork(self, agent: str) -> DataFrame:
        """The session that processing would take next for an agent, with its windows: session_id, win_no, role, content, idx."""
        return self.windows(self.next_unprocessed(agent)).drop("agent_id")

    # Writes. What belongs together is committed together: a reader sees all of it or nothing.

    def _commit(self, change: Callable[[Transaction], T], still: Callable[[], bool] = lambda: True) -> T:
        out = self.store.commit(change, still=still)
        self.recalled.rows.clear()
        return out

    def save_edges(self, edges: DataFrame, tx: Transaction | None = None) -> None:
        """edges with seq: contradicts in both directions, the last of equal keys."""
        (tx or self.store).upsert("edges", add_edge_pairs(edges).drop("seq"))

    def save_vectors(self, vectors: DataFrame) -> None:
        """vectors: id, agent_id, kind ('': wiki_page), v. Stored with length one; vectors whose dimension isn't the store's are refused, also if another writer was first to say which."""
        self._commit(lambda tx: I.save_vectors(tx, vectors))

    def reindex_vectors(self, agents: DataFrame) -> None:
        """New cells for the vectors of agents (agent_id); worth it when these have doubled since."""
        self._commit(lambda tx: I.rebuild_cells(tx, agents))

    def persist(
        self,
        changes: DataFrame,
        now: Column,
        details: DataFrame | None = None,
        contradictions: DataFrame | None = None,
        vectors: DataFrame | None = None,
    ) -> DataFrame:
        """Applies P.adjudicate's changes in one commit, and returns what each point became: agent_id, id, action, and the columns of interest_points.

        An update starts from the stored point and replaces only what the change names; an archived point only changes its status, and
        loses its vector; a created one takes its confidence from its importance and is unknown in reliability and freshness. details: agent_id, id and any
        further columns of created points (subjective, wiki_worthy, turn ranges, sessions). contradictions: rows of P.resolve_contradictions,
        stored with an edge in both directions. vectors (agent_id, id, v): those of created and updated points, stored, and related to one another
        where they are similar enough.
        """
        write = scratch(self.spark)
        given = [None if df is None else write(df, f"given{i}") for i, df in enumerate((changes, details, contradictions, vectors))]
        return self._commit(lambda tx: self._persist(tx, given[0], now, *given[1:]))

    def _persist(
        self, tx: Transaction, changes: DataFrame, now: Column, details: DataFrame | None = None, contradictions: DataFrame | None = None, vectors: DataFrame | None = None
    ) -> DataFrame:
        write, c = scratch(self.spark), self.config.fork
        rows = write(P.changed_points(changes, tx.read_for("interest_points", changes), now, details), "changes")
        tx.upsert("interest_points", rows.drop("action"))
        gone = rows.filter("action = 'archive'").select("agent_id", F.lit("interest_point").alias("kind"), "id")
        tx.delete("vectors", gone)
        edges = []
        if contradictions is not None:
            tx.upsert("contradictions", contradictions)
            edges.append(
                contradictions.select(
                    "agent_id",
                    F.col("left_id").alias("source_id"),
                    F.col("right_id").alias("target_id"),
                    F.lit("contradicts").alias("kind"),
                    F.lit(1.0).alias("weight"),
                    now.alias("created_at"),
                    F.lit(0).alias("seq"),
                ),
            )
        if vectors is not None:
            alive = rows.filter("action != 'archive'").select("agent_id", "id")
            kept = write(vectors.join(alive, ["agent_id", "id"], "left_semi").filter("v is not null"), "kept_vectors")
            I.save_vectors(tx, kept.select("id", "agent_id", F.lit("interest_point").alias("kind"), "v"))
            near = P.related_edges(kept.select("agent_id", "id", F.xxhash64("id").alias("ord"), "v"), c.similarity_relate, now)
            edges.append(near.withColumn("seq", F.lit(1)))
        if edges:
            self.save_edges(write(reduce(DataFrame.unionByName, edges), "edges"), tx)
        log = rows.select(
            hash_id("agent_id", "id", now.cast("string")).alias("id"),
            "agent_id",
            now.alias("created_at"),
            F.lit("interest_point").alias("entity_kind"),
            F.col("id").alias("entity_id"),
            F.col("name").alias("title"),
            "action",
        )
        tx.append_log(log, self.config.log_retain)
        return rows

    def ask(self, prompts: DataFrame) -> DataFrame:
        return providers.ask(prompts, self.chat)

    def embed(self, texts: DataFrame, strict: bool = True) -> DataFrame:
        """texts (any keys, text) with v. Vectors are kept in the store by model, dimension and content: only texts that no run has embedded are sent to the provider, each once. strict=False: a
        text that the provider fails on gets a null vector, and a column error says why."""
        write, c = scratch(self.spark), self.config
        texts = write(texts, "texts")
        key = V.embed_key(F.lit(c.embedding_model), F.lit(c.embedding_dimensions), F.col("text"))
        asked = write(texts.select("text").filter("text is not null").distinct().withColumn("key", key), "asked")
        kept = self.store.snapshot().read("embedded", self.store.parts_of(asked))
        known = write(asked.join(kept, "key").dropDuplicates(["key"]), "known")
        missing = asked.join(known.select("key"), "key", "left_anti")
        new = write(missing.join(providers.embed_distinct(missing.select("text"), self.embedder, strict=strict), "text"), "embedded")
        if new.filter("v is not null").limit(1).count():
            self.store.append("embedded", new.filter("v is not null").select("key", "v"))
        no_error = F.lit(None).cast("string").alias("error")
        found = known.select("text", "v", no_error).unionByName(new.select("text", "v", "error"))
        out = texts.join(found, "text", "left")
        return out.drop("error") if strict else out

    def process_next(self, now: Column) -> int:
        """Processes the oldest unprocessed session of each agent, and says how many these were (see process_round)."""
        return self.process_round(now).count()

    def process_round(self, now: Column, skip: DataFrame | None = None) -> DataFrame:
        """Processes the oldest unprocessed session of each agent (without those of skip: agent_id, session_id): candidates, merging, clustering, adjudication, points, edges, and, where the wiki
        is on, pages, their links and the pages around them. Returns the jobs: agent_id, session_id, status (done or failed), error; they are also stored.

        Each agent's session is committed as a whole, with its mark. One that fails, or for which the time of a job isn't enough, leaves nothing behind and stays unprocessed, and the other agents'
        sessions are processed all the same. Without providers, and for sessions without turns or candidates, only the mark is set.
        """
        write = scratch(self.spark)
        waiting = self.store.read("session_transcripts")
        if skip is not None:
            waiting = waiting.join(skip, ["agent_id", "session_id"], "left_anti")
        sessions = write(Z.oldest_unprocessed(waiting), "sessions")

        def process(rows: DataFrame, still: Callable[[], bool]) -> None:
            self._commit(lambda tx: self._process(tx, rows, now), still)

        jobs = run_isolated(sessions, process, self.config.job_timeout_minutes * 60, write)
        if jobs.limit(1).count():
            done = jobs.withColumns({"id": hash_id("agent_id", "session_id", now.cast("string")), "created_at": now, "done_at": now})
            self.store.upsert("jobs", done)
        return jobs

    def _process(self, tx: Transaction, sessions: DataFrame, now: Column) -> None:
        write = scratch(self.spark)
        if self.chat and self.embedder:
            found = write(Z.extract(sessions, self.ask, self.config), "candidates")
            if found.limit(1).count():
                self._consolidate(tx, sessions, found, now, write)
        tx.mark_processed(sessions, now)

    def _embed_or_fail(self, texts: DataFrame) -> DataFrame:
        """Vectors of texts of many agents; Failures names the agents that the provider fails for."""
        out = scratch(self.spark)(self.embed(texts, strict=False), "vectors")
        failed = out.filter("error is not null").select("agent_id", "error")
        if failed.limit(1).count():
            raise Failures(failed)
        return out.drop("error")

    def _consolidate(self, tx: Transaction, sessions: DataFrame, found: DataFrame, now: Column, write: Callable[[DataFrame, str], DataFrame]) -> None:
        c = self.config
        points = Z.merge_candidates(found, self.ask, self._embed_or_fail, c, write)
        stored = tx.read_for("interest_points", sessions)
        related = Z.relate(points, tx.read_for("vectors", sessions), c, write)
        verdicts = Z.ask_adjudication(points, related, stored, self.ask, write)
        changes = write(Z.changes_of(verdicts, stored, now), "all_changes")
        sides = P.resolve_contradictions(verdicts["contradictions"], verdicts["members"].select("agent_id", "component", "topic"), verdicts["history"], now)
        details = points.select(
            "agent_id", "id", "subjective", F.col("start").alias("turn_range_start"), F.col("end").alias("turn_range_end"), F.col("worthy").alias("wiki_worthy"),
            F.array("session_id").alias("source_session_ids"),
        )
        texts = changes.filter("action != 'archive'").select("agent_id", "id", candidate_text("name", "summary").alias("text"))
        vectors = write(self._embed_or_fail(texts).select("agent_id", "id", "v").dropDuplicates(["agent_id", "id"]), "new_vectors")
        rows = self._persist(tx, changes, now, write(details, "details"), write(sides, "sides"), vectors)
        if not c.wiki_enabled:
            return
        alive = rows.filter("action != 'archive'").join(vectors, ["agent_id", "id"], "left")
        alive = alive.withColumnsRenamed({"turn_range_start": "start", "turn_range_end": "end"})
        alive = write(alive, "survivors")
        known = tx.read_for("vectors", sessions).select("agent_id", "id", F.xxhash64("id").alias("ord"), "kind", F.col("embedding").alias("v"))
        near = write(S.related_entries(alive, known, tx.read_for("interest_points", sessions), tx.read_for("wiki_pages", sessions)), "related")
        drafts = write(Z.draft_pages(alive, sessions, near, self.ask, c, write), "drafts")
        self._wiki_write(tx, drafts, now)
        touched = write(drafts.select("agent_id", normalize_id("id").alias("id")).distinct(), "touched")
        self._rebuild_links(tx, touched, now)
        seeds = touched.unionByName(rows.filter("action = 'archive'").select("agent_id", "id"))
        again = write(Z.reconcile(seeds, tx.read_for("edges", sessions), tx.read_for("wiki_pages", sessions), self.ask, c), "rewrites")
        if again.limit(1).count():
            self._wiki_write(tx, again, now)
            self._rebuild_links(tx, again.select("agent_id", "id").distinct(), now)

    def process_all(self, now: Column) -> int:
        """process_round until no session is left (an agent's sessions in order of receipt), and how many were done. Sessions that fail stay unprocessed and are in self.jobs(); the
        sessions of their agent that came after them are processed."""
        done, failed, write = 0, None, scratch(self.spark)
        while True:
            jobs = self.process_round(now, failed)
            counts = {r["status"]: r["count"] for r in jobs.groupBy("status").count().collect()}
            if not counts:
                return done
            done += counts.get("done", 0)
            if counts.get("failed"):
                lost = jobs.filter("status = 'failed'").select("agent_id", "session_id")
                failed = write(lost if failed is None else failed.unionByName(lost), f"failed{done}-{uuid.uuid4().hex[:6]}")

    def jobs(self, agent: str | None = None) -> DataFrame:
        """What became of sessions: id, agent_id, session_id, status, error, created_at, done_at."""
        rows = self.store.read("jobs")
        return rows if agent is None else rows.filter(F.col("agent_id") == agent)

    def wiki_write(self, writes: DataFrame, now: Column) -> None:
        """Page writes, each page once, in one commit: pages, the edges of their points, claims, vectors (with an embedder) and the log."""
        writes = scratch(self.spark)(writes, "page_writes")
        self._commit(lambda tx: self._wiki_write(tx, writes, now))

    def _wiki_write(self, tx: Transaction, writes: DataFrame, now: Column) -> None:
        out = P.write_pages(writes, tx.read_for("wiki_pages", writes), now)
        write = scratch(self.spark)
        out = {name: write(df, f"page_{name}") for name, df in out.items()}
        for table in ("wiki_pages", "edges", "claims"):
            tx.upsert(table, out[table])
        if self.embedder:
            v = self._embed_or_fail(out["texts"])
            I.save_vectors(tx, v.select("id", "agent_id", F.lit("wiki_page").alias("kind"), "v"))
        tx.append_log(out["change_log"], self.config.log_retain)

    def rebuild_links(self, touched: DataFrame, now: Column, strict_parity: bool = False) -> None:
        """The reference edges and pending links of touched pages (agent_id, id), and pending links to them, from the pages' texts; in one commit, which only writes the parts of their agents."""
        touched = scratch(self.spark)(touched, "touched")
        self._commit(lambda tx: self._rebuild_links(tx, touched, now, strict_parity))

    def _rebuild_links(self, tx: Transaction, touched: DataFrame, now: Column, strict_parity: bool = False) -> None:
        if not (parts := self.store.parts_of(touched)):
            return
        pages, old_edges, old_pending = (tx.read(t, parts) for t in ("wiki_pages", "edges", "pending_links"))
        edges, pending = G.rebuild_links(touched, pages, old_edges, old_pending, now, strict_parity)
        write = scratch(self.spark)
        for table, rows in [(t, write(df, t)) for t, df in (("edges", edges), ("pending_links", pending))]:
            tx.write(table, rows, parts)

    def prune_logs(self, default_cap: int, caps: DataFrame | None = None) -> None:
        self.store.update("change_log", lambda old: retain_newest(old, default_cap, caps))

    def windows(self, transcripts: DataFrame) -> DataFrame:
        """The windows of transcripts by the configured route: agent_id, session_id, win_no, role, content, idx."""
        f, key = self.config.fork, ["agent_id", "session_id"]
        turns = explode_transcripts(transcripts, key, strict=False)
        if f.route == "non_prefix":
            return W.disjoint_windows(turns, key, f.prefix_step, f.max_windows)
        if f.route in ("full", "full2"):
            return turns.withColumn("win_no", F.lit(0))
        ends = W.prefix_windows(turns, key, f.prefix_step, f.max_windows).select(*key, "win_no", "end_idx")
        return turns.join(ends, key).filter(F.col("idx") <= F.col("end_idx")).select(*turns.columns, "win_no")
