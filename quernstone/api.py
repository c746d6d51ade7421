"""The engine as a library: register checkouts, index them, and ask. One method per command."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from hashlib import sha256
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions.code import affinity_terms, embedding_document
from quernstone.functions.text import query_terms
from quernstone.operators import context, hints, publish, trace
from quernstone.operators.chunking import line_windows
from quernstone.operators.extract import build_graph, graph_statistics
from quernstone.operators.flow import files_of_flow, rank_flow, reasons
from quernstone.operators.graph import lineage_of
from quernstone.operators.results import diverse_hits, similar_names, snippets, best_lines
from quernstone.operators.search import Reranker, cached_vectors, deep_seeds, hybrid_hits, mixed_intent, retrieve, with_authority
from quernstone.operators.vector import backlog, semantic_status, usable
from quernstone.session import cut
from quernstone.sources.registry import Registry
from quernstone.sources.store import ProjectStore, keep_ids
from quernstone.sources.tree import head_commit, scan_scripts, scan_tree
from quernstone.tables import CHUNK_EMBEDDINGS, CHUNKS, conformed

EXTRACTOR_VERSION = 2
MOST_SHOWN, HINTS, DEEP_HINTS = 6, 3, 12


@cache
def extractor_fingerprint() -> str:
    """The extractor's version and a hash of its code: graphs of other code are out of date."""
    folder = Path(__file__).parent / "operators"
    code = b"".join((folder / name).read_bytes() for name in ("extract.py", "chunking.py", "classify.py"))
    return f"{EXTRACTOR_VERSION}-{sha256(code).hexdigest()[:20]}"


class Engine:
    """Projects by name, their published tables in a folder, and the questions that can be asked of them.

    model names the vectors that count. embed makes vectors of texts (hash, text -> hash, vector); without it, retrieval is lexical.
    reranker is the second stage. All answers are DataFrames or small objects; nothing but a question's own lists is collected.
    """

    def __init__(self, spark: SparkSession, folder: str, registry: Registry, model: str = "default", embed: Callable[[DataFrame], DataFrame] | None = None, reranker: Reranker | None = None):
        self.spark, self.store, self.registry = spark, ProjectStore(spark, folder), registry
        self.model, self.embed_texts, self.reranker, self._questions = model, embed, reranker or Reranker(), {}

    # -- projects
    def register(self, name: str, root: str, description: str = "") -> None:
        self.registry.add(name, root, description)

    def unregister(self, name: str) -> dict[str, int]:
        """Forget a project and remove its rows; the checkout stays. How many rows each table lost."""
        self.registry.remove(name)
        return self.store.purge(name)

    def index(self, name: str, force: bool = False) -> dict:
        """Chunks and graph of a checkout, published as one generation; nothing is done if it is what is published already.

        Chunks that stay keep their ids, and with them their vectors. What is published is what was scanned: the commit is looked at
        before and behind it, and a change in between refuses the generation.
        """
        root = self.registry.entries()[name]["root"]
        commit, version = head_commit(root), extractor_fingerprint()
        files = cut(scan_tree(self.spark, root, name).unionByName(scan_scripts(self.spark, root, name)).dropDuplicates(["path"]))
        windows = line_windows(files).withColumn("commit_hash", F.lit(commit))
        digest = publish.project_digests(windows).first()
        about = {"commit_hash": commit, "content_digest": digest["digest"] if digest else "", "extractor_version": version}
        before = self.store.snapshot(name)
        if before and not force and all(before.get(k) == v for k, v in about.items()):
            return {"project": name, "changed": False, **about, "generation_id": before["generation_id"]}
        generation = sha256(repr(sorted(about.items())).encode()).hexdigest()[:16]
        if before and before["generation_id"] == generation:
            generation += "r" if not generation.endswith("r") else ""
        fresh = windows.withColumn("generation_id", F.lit(generation)).withColumn("id", F.xxhash64("project", "path", "start_line", "end_line", F.sha2("content", 256), F.lit(generation)))
        chunks = cut(conformed(keep_ids(self.store.read("chunks", name), fresh), CHUNKS))
        graph = {k: cut(v) for k, v in build_graph(chunks).items()}
        about["graph_digest"] = next((r["digest"] for r in publish.graph_digests(graph["edges"], graph["symbols"]).collect()), "")

        def check(written: dict[str, DataFrame]) -> None:
            for table, df in written.items():
                if df.where(~F.col("generation_id").eqNullSafe(F.lit(generation))).limit(1).count():
                    raise ValueError(f"{table} holds rows of another generation")
            if head_commit(root) != commit:
                raise ValueError("the checkout changed while it was indexed")

        pointer = self.store.publish(name, generation, {"chunks": chunks, **graph}, about, check)
        stats = graph_statistics(graph["symbols"], graph["edges"]).first()
        return {"project": name, "changed": True, **{k: v for k, v in pointer.items() if k != "tables"}, "files": files.count(), "chunks": chunks.count(), **({k: stats[k] for k in ("symbols", "edges", "unresolved", "module_owned")} if stats else {})}

    def structure(self, name: str | None = None) -> list[dict]:
        """Index one or all projects anew, whatever is published."""
        return [self.index(p, force=True) for p in ([name] if name else self.registry.entries())]

    def embed(self, name: str | None = None) -> dict[str, int]:
        """Make the vectors that are missing, once per text. How many chunks of each project were without one."""
        out = {}
        for project in [name] if name else self.store.projects():
            chunks, held = self._table("chunks", project), self._vectors(project)
            todo = cut(backlog(chunks.where("content is not null"), held, self.model).select("id", embedding_document(F.col("project"), F.col("path"), F.col("content")).alias("text")))
            out[project] = todo.count()
            if out[project] and self.embed_texts:
                known = held.where(F.col("model") == self.model).join(chunks.select(F.col("id").alias("chunk_id"), F.sha2(embedding_document(F.col("project"), F.col("path"), F.col("content")), 256).alias("hash")), "chunk_id").select("hash", F.col("vector").cast("array<double>").alias("vector")).dropDuplicates(["hash"])
                vectors, _ = cached_vectors(todo, known, self.embed_texts)
                rows = todo.select(F.col("id").alias("chunk_id"), F.sha2("text", 256).alias("hash")).join(vectors, "hash")
                made = rows.select("chunk_id", F.lit(self.model).alias("model"), F.size("vector").alias("dimension"), F.col("vector").cast("array<float>").alias("vector"), F.current_timestamp().alias("embedded_at"))
                self.store.upsert_embeddings(project, cut(made))
        return out

    def status(self) -> DataFrame:
        """project, commit_hash, generation_id, indexed_at, chunks, vectors, pending, pending_ratio, recommendation of every project."""
        debt = semantic_status(self._table("chunks"), self._vectors(), self.model)
        return self.store.repos().select("project", "commit_hash", "generation_id", "indexed_at").join(debt, "project", "left")

    # -- questions
    def _table(self, name: str, project: str | None = None) -> DataFrame:
        df = self.store.read(name, project)
        if df is None:
            raise LookupError(f"{project or 'nothing'} isn't indexed: index it first" if project else "nothing is indexed")
        return df

    def _vectors(self, project: str | None = None) -> DataFrame:
        df = self.store.read("chunk_embeddings", project)
        return self.spark.createDataFrame([], CHUNK_EMBEDDINGS) if df is None else df

    def query_vector(self, question: str) -> list[float]:
        """The question's vector, made once per question."""
        key = sha256(f"{self.model}\x1f{question}".encode()).hexdigest()
        if key not in self._questions:
            rows = self.embed_texts(self.spark.createDataFrame([(key, question)], "hash string, text string")).collect() if self.embed_texts else []
            self._questions[key] = [float(x) for x in rows[0]["vector"]] if rows else []
        return self._questions[key]

    def hits(self, question: str, project: str | None = None, mode: str = "auto") -> tuple[DataFrame, bool, str | None]:
        """(hits with rank from 0, whether they were reranked, why not)."""
        chunks, authority = self._table("chunks", project), self._table("source_authority", project)
        query = self.query_vector(question)
        held = self._vectors(project).where((F.col("model") == self.model) & usable(F.col("vector"), F.col("dimension")) & (F.col("dimension") == len(query)))
        vectors = held.groupBy("chunk_id").agg(F.max_by("vector", "embedded_at").alias("vector"))
        found, second, why = retrieve(lambda n: hybrid_hits(chunks, authority, vectors, query, question, n), question, mode, self.reranker)
        ranked = found.withColumn("rank", (F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1).cast("int"))
        return cut(ranked), second, why

    def search(self, question: str, project: str | None = None, mode: str = "auto", limit: int = MOST_SHOWN) -> dict[str, DataFrame | str | None]:
        """hits: a few diverse ones with snippets; relationship_hints, anchor_relationships and contract_differences of them."""
        hits, second, why = self.hits(question, project, mode)
        shown = diverse_hits(hits.withColumn("question", F.lit("q")).select("question", "id", "project", "path", "start_line", "end_line", "score", "authority"), max(1, min(limit, MOST_SHOWN)), mixed=mixed_intent(question))
        own = hits.join(shown.select("id", "place"), "id")
        cutouts = snippets(own.select("id", "start_line", "content"), best_lines(own.select("id", "start_line", "content"), query_terms(question)))
        out = own.join(cutouts, "id", "left").select("place", "project", "path", "start_line", "end_line", "authority", "score", "first_line", "snippet")
        return {"hits": out, "mode": "code" if second else "fast", "fallback": why, **self._graph_about(question, hits, project, HINTS)}

    def _graph_about(self, question: str, hits: DataFrame, project: str | None, limit: int) -> dict[str, DataFrame]:
        symbols, edges, chunks = (self._table(t, project) for t in ("symbols", "edges", "chunks"))
        listed = self._table("source_authority", project)
        near = cut(hints.relationship_hints(question, hits, symbols, edges, chunks, with_authority(listed.select("project", "path").distinct(), listed), limit))
        return {"relationship_hints": near, "anchor_relationships": hints.anchor_relationships(hits, symbols, edges, limit), "contract_differences": hints.hit_contracts(hits, near, symbols, edges, limit)}

    def related(self, name: str, project: str | None = None, path: str | None = None, limit: int = 50) -> dict[str, DataFrame]:
        """card: a symbol's definitions, alternatives, calls and relations; suggestions: names like it, if nothing bears it."""
        symbols = self._table("symbols", project)
        card = cut(hints.symbol_card(symbols, self._table("edges", project), name, limit, path))
        near = similar_names(symbols.where("active = 1"), name)
        return {"card": card, "suggestions": near if card.isEmpty() else near.limit(0)}

    def investigate_flow(self, question: str, project: str, limit: int = 16) -> dict[str, DataFrame]:
        """evidence, reasons, impact, coverage, lineage and consumers of the files that bear on a question, and the diagnosis of what was found."""
        hits, _, _ = self.hits(question, project)
        seeds = cut(deep_seeds(hits).where("seed <= 6").select("project", "path", F.col("seed").alias("rank")))
        symbols, edges, chunks = (self._table(t, project) for t in ("symbols", "edges", "chunks"))
        stated = with_authority(chunks.select("project", "path").distinct(), self._table("source_authority", project))
        texts = chunks.join(stated, ["project", "path"])
        terms = affinity_terms(query_terms(question))
        found = cut(trace.all_reasons(reasons(seeds, edges, symbols, chunks, terms), seeds, edges, symbols, texts, stated, terms))
        files = rank_flow(files_of_flow(found), max(6, min(limit, 30))).select("project", "path", "score", "lane", "place")
        own = files.join(context.compact_reasons(found), ["project", "path"]).join(stated, ["project", "path"], "left")
        evidence = cut(own.join(trace.file_roles(own, edges, question), ["project", "path"]))
        told = found.join(evidence.select("project", "path"), ["project", "path"], "left_semi")
        scripts = symbols.where("kind = 'function' and active = 1").join(evidence.select("project", "path"), ["project", "path"], "left_semi").select("project", "name").distinct()
        names = cut(trace.relevant_procedures(scripts, edges, terms))
        lines, used = lineage_of(symbols, chunks, names), trace.consumers(names, texts)
        counts = used.groupBy("project").agg(F.count_distinct("path").alias("consumers")).join(lines.groupBy("project").agg(F.count(F.lit(1)).alias("lineage_entries")), "project", "full_outer")
        flow = trace.coverage(evidence, question).join(counts, "project", "left")
        for column in ("uninvalidated_keys", "lineage_missing", "facets_missing"):
            flow = flow.withColumn(column, F.lit(""))
        diagnosis = trace.diagnose(evidence, told, flow.withColumn("shared_consumers", F.lit(0)))
        return {"evidence": evidence, "reasons": told, "impact": trace.impact(evidence, texts), "coverage": trace.coverage(evidence, question), "lineage": lines, "consumers": used, "diagnosis": diagnosis}

    def diagnose_retrieval(self, question: str, project: str) -> DataFrame:
        return self.investigate_flow(question, project)["diagnosis"]

    def load_deep_context(self, question: str, project: str, budget: int = 36_000) -> DataFrame:
        """The source that bears on a question, within a budget of tokens, and what was left out and why. The index has to be up to date."""
        about = self.store.snapshot(project)
        if about is None:
            raise LookupError(f"{project} isn't indexed: index it first")
        if about["commit_hash"] != head_commit(self.registry.entries()[project]["root"]) or about["extractor_version"] != extractor_fingerprint():
            raise LookupError(f"the index of {project} is stale: refresh it")
        hits, _, _ = self.hits(question, project, "code" if self.reranker.available else "auto")
        symbols, edges, chunks = (self._table(t, project) for t in ("symbols", "edges", "chunks"))
        near, flow = self._graph_about(question, hits, project, DEEP_HINTS), self.investigate_flow(question, project, 30)
        place = lambda df, rank="0": df.select("project", "path", F.col("start_line"), F.col("end_line"), F.expr(rank).cast("int").alias("rank"))
        first = lambda df: df.withColumn("start_line", F.lit(1)).withColumn("end_line", F.lit(1))
        anchors = near["anchor_relationships"].withColumn("project", F.lit(project)).withColumn("start_line", F.col("s0")).withColumn("end_line", F.col("s1"))
        sides = near["contract_differences"].select(F.lit(project).alias("project"), F.explode(F.array("from_path", "related_path")).alias("path"))
        sources = {
            "hit": place(hits, "rank"), "reverse_hint": place(near["relationship_hints"]), "anchor": place(anchors), "contract": place(first(sides)),
            "lineage": place(flow["lineage"].withColumnRenamed("first_line", "start_line").withColumnRenamed("last_line", "end_line")), "rpc_consumer": place(first(flow["consumers"])), "impact": place(first(flow["impact"])), "flow": place(first(flow["evidence"])),
            "neighbour": place(first(self._neighbours(hits, edges)), "rank"),
        }
        fused = with_authority(context.fuse_candidates(sources, query_terms(question)), self._table("source_authority", project))
        return context.dossier(fused, symbols, chunks, query_terms(question), budget)

    @staticmethod
    def _neighbours(hits: DataFrame, edges: DataFrame) -> DataFrame:
        """project, path, rank: the files that the first hits' files reach over one resolved edge."""
        own = hits.where("rank < 18").groupBy("project", "path").agg(F.min("rank").alias("rank"))
        links = edges.where("target_path is not null and resolution_confidence <> 'unresolved' and target_path <> source_path").select("project", F.col("source_path").alias("path"), "target_path")
        return own.join(links, ["project", "path"]).groupBy("project", F.col("target_path").alias("path")).agg(F.min("rank").alias("rank"))
