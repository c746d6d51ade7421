"""The engine end to end on a small checkout, and the parts it is made of."""

import subprocess

import pytest
from pyspark.sql import functions as F

from quernstone.api import Engine, extractor_fingerprint
from quernstone.operators import atlas, context, hints, ledger, publish, trace
from quernstone.operators.search import Reranker, cached_vectors, mixed_intent, retrieve, should_rerank
from quernstone.sources.registry import Registry
from quernstone.sources.store import ProjectStore
from quernstone.sources.tree import all_files, head_commit, listed_files, require_clean, scan_scripts, scan_tree
from quernstone.streaming.refresh import claim_stream, refresh_projects
from quernstone.tables import CHUNK_EMBEDDINGS, CHUNKS, EDGES, SYMBOLS, conformed
from tests.test_core import chunk, edge, symbol

FILES = {
    "src/retry.ts": 'import { reconcile } from "./reconcile";\nexport function retryCommand(id) {\n  reconcile(id);\n  return isStale(id);\n}\nfunction isStale(x) { return x; }\n',
    "src/reconcile.ts": 'export function reconcile(id) {\n  return db.rpc("reconcile_booking", { id });\n}\n',
    "src/other.ts": 'import { reconcile } from "./reconcile";\nexport function sweep() {\n  reconcile(1);\n}\n',
    "test/retry.test.ts": 'import { retryCommand } from "../src/retry";\ntest("retry", () => { retryCommand(1); });\n',
    "db/migrations/20260101_a.sql": "create or replace function public.reconcile_booking(id int) returns int language sql as $$\n  update bookings set state = 'x' where id = id returning id;\n$$;\n",
    "db/migrations/20260201_b.sql": "create or replace function public.reconcile_booking(id int) returns int language sql as $$\n  update bookings set state = 'y' returning id;\n$$;\n",
    ".env": "A=1\n", "ignored.ts": "export const x = 1;\n", ".gitignore": "ignored.ts\n",
}


@pytest.fixture
def checkout(tmp_path):
    root = tmp_path / "checkout"
    for name, text in FILES.items():
        file = root / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "src", "test", "db", ".gitignore")
    git("commit", "-qm", "one")
    (root / "new.ts").write_text("export const fresh = 1;\n")
    return root, git


def lengths(texts):
    """Vectors without a model: lengths and counts of letters."""
    return texts.select("hash", F.array(F.length("text").cast("double"), *[F.length(F.regexp_replace("text", f"[^{c}]", "")).cast("double") for c in "aeirst"]).alias("vector"))


def test_git_listing(spark, checkout):
    root, git = checkout
    assert set(listed_files(str(root))) == {n for n in FILES if n != "ignored.ts"} | {"new.ts"}
    assert {r.path for r in scan_tree(spark, str(root), "p").collect()} == {"src/retry.ts", "src/reconcile.ts", "src/other.ts", "test/retry.test.ts", "db/migrations/20260101_a.sql", "db/migrations/20260201_b.sql", "new.ts"}
    assert {r.path for r in all_files(spark, str(root), "p").collect()} >= {".env", "new.ts"} and len(head_commit(str(root))) == 40
    with pytest.raises(ValueError):
        require_clean(str(root))
    (root / "__init__.py").write_text("x = 1\n")
    assert "__init__.py" in {r.path for r in scan_tree(spark, str(root), "p").collect()}
    (root / "bad.sql").write_bytes(b"select 1 as \xffx;")
    assert {r.path: r.content for r in scan_scripts(spark, str(root), "p").collect()}["bad.sql"] == "select 1 as x;"


def test_engine(spark, checkout, tmp_path):
    root, git = checkout
    engine = Engine(spark, str(tmp_path / "store"), Registry(tmp_path / "projects.json"), "m", lengths, Reranker(lambda q, d: d.select("id", F.length("document").alias("second"))))
    engine.register("p", str(root))
    with pytest.raises(LookupError):
        engine.related("retryCommand", "p")
    first = engine.index("p")
    assert first["changed"] and first["files"] == 7 and first["symbols"] >= 9 and not engine.index("p")["changed"]
    assert engine.embed("p") == {"p": 7} and engine.embed() == {"p": 0}
    ids = {r.path: r.id for r in engine.store.read("chunks", "p").collect()}
    (root / "src/other.ts").write_text(FILES["src/other.ts"] + "export function more() { return 2; }\n")
    assert engine.index("p")["changed"]
    now = {r.path: r.id for r in engine.store.read("chunks", "p").collect()}
    assert now["src/retry.ts"] == ids["src/retry.ts"] and now["src/other.ts"] != ids["src/other.ts"] and engine.embed("p") == {"p": 1}
    row = engine.status().first()
    assert (row.project, row.chunks, row.vectors, row.recommendation) == ("p", 7, 7, "current")
    edges = engine.store.read("edges", "p")
    assert edges.where("relation = 'calls_rpc'").first().target_path == "db/migrations/20260201_b.sql"
    answer = engine.search("Where does the retry command reconcile a booking after a provider failure timeout?", "p", "code")
    shown = {r.path for r in answer["hits"].collect()}
    assert answer["mode"] == "code" and "src/reconcile.ts" in shown and len(shown) <= 6
    assert {r.path for r in answer["relationship_hints"].collect()} & {"src/other.ts", "src/retry.ts"}
    card = {(r.part, r.name) for r in engine.related("retryCommand", "p")["card"].collect()}
    assert ("definition", "retryCommand") in card and ("call", "reconcile") in card and any(part == "incoming" for part, _ in card)
    assert [r.name for r in engine.related("retryComand", "p")["suggestions"].collect()][0] == "retryCommand"
    flow = engine.investigate_flow("Which rpc writers reconcile a booking and which tests cover retry?", "p")
    assert {"src/reconcile.ts", "src/retry.ts"} <= {r.path for r in flow["evidence"].collect()}
    assert engine.diagnose_retrieval("retry of a booking", "p").first().quality in ("weak", "review", "healthy")
    rows = engine.load_deep_context("Where is a booking reconciled in the retry worker?", "p").collect()
    assert {r.path for r in rows if r.fate == "included"} >= {"src/reconcile.ts"} and sum(len(r.content or "") for r in rows) / 4 < 36_000
    git("add", "-A")
    git("commit", "-qm", "two")
    with pytest.raises(LookupError, match="refresh"):
        engine.load_deep_context("retry", "p")
    assert engine.structure() and engine.unregister("p")["chunks"] == 7 and engine.store.projects() == [] and (root / "src/retry.ts").exists()
    assert extractor_fingerprint() == extractor_fingerprint() and extractor_fingerprint().startswith("2-")


def test_a_failed_publishing_leaves_the_old_generation(spark, tmp_path):
    store = ProjectStore(spark, str(tmp_path / "s"))
    df = spark.createDataFrame([chunk(1, "p", "a.ts", 1, "a")], CHUNKS)
    store.publish("p", "g1", {"chunks": df}, {"commit_hash": "c"})
    store.publish("q", "g9", {"chunks": df}, {"commit_hash": "d"})

    def refuse(_):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        store.publish("p", "g2", {"chunks": df.limit(0)}, {}, refuse)
    assert store.snapshot("p")["generation_id"] == "g1" and store.read("chunks", "p").count() == 1 and store.read("chunks").count() == 2
    store.publish("p", "g3", {"chunks": df.limit(0)}, {"commit_hash": "e"})
    assert store.read("chunks", "p").count() == 0 and store.read("chunks", "q").count() == 1 and {r.project: r.generation_id for r in store.repos().collect()} == {"p": "g3", "q": "g9"}
    vectors = lambda *rows: spark.createDataFrame([(i, "m", 1, [v], None) for i, v in rows], CHUNK_EMBEDDINGS)
    store.publish("p", "g4", {"chunks": df}, {"commit_hash": "e"})
    store.upsert_embeddings("p", vectors((1, 1.0), (2, 5.0)))
    store.upsert_embeddings("p", vectors((1, 1.0)))
    assert [(r.chunk_id, list(r.vector)) for r in store.read("chunk_embeddings", "p").collect()] == [(1, [1.0])]
    assert store.purge("p")["chunk_embeddings"] == 1 and store.snapshot("p") is None and store.read("chunks").count() == 1


def test_policy(spark):
    own = Reranker(lambda q, d: d.select("id", F.lit(1.0).alias("second")))
    long = "Where does the retry worker handle a provider failure in the outbox?"
    assert [should_rerank(long, m, own) for m in ("auto", "fast", "code")] == [True, False, True] and not should_rerank(long, "auto", Reranker()) and not should_rerank("retry", "auto", own)
    with pytest.raises(ValueError):
        should_rerank("x", "slow", own)
    assert mixed_intent("Fix the adapter and add regression tests") and not mixed_intent("Where are the tests?")
    hits = spark.createDataFrame([(1, "a", "x", 0.5), (2, "b", "y", 0.4)], "id bigint, path string, content string, score double")
    pools = []
    search = lambda n: pools.append(n) or hits

    def fails(question, documents):
        raise RuntimeError("down")

    assert retrieve(search, long, "auto", Reranker(fails))[1:] == (False, "down") and pools == [60]
    with pytest.raises(RuntimeError):
        retrieve(search, long, "code", Reranker(fails))
    assert retrieve(search, "retry", "fast", own)[1] is False and pools[-1] == 24
    calls = []

    def embed(texts):
        calls.append(texts.count())
        return lengths(texts)

    texts = spark.createDataFrame([("a",), ("a",), ("bb",), (None,)], "text string")
    empty = spark.createDataFrame([], "hash string, vector array<double>")
    vectors, new = cached_vectors(texts, empty, embed)
    assert vectors.count() == 2 and cached_vectors(texts, vectors, embed)[1].count() == 0 and calls == [2, 0]


def test_dispatched_overrides(spark):
    """A base that dispatches to copy, which five subclasses override."""
    rows = [edge(0, source_path="base.ts", source_name="clone", target_name="copy", target_qualified_name="Base.copy", target_path="base.ts")]
    rows += [edge(k, source_path=f"{n}.ts", source_name="copy", relation="overrides", target_name="copy", target_qualified_name="Base.copy", target_path="base.ts") for k, n in enumerate(("Line", "Mesh", "Points", "Sprite", "Bone"), 1)]
    rows += [edge(9, source_path="base.ts", relation="invokes_edge_function", target_name="send", target_path=None), edge(10, source_path="x.ts", relation="calls", target_path="base.ts", resolution_confidence="unresolved")]
    files = spark.createDataFrame([("p", "supabase/functions/send/index.ts")], "project string, path string")
    got = {(r.path, r.kind, r.score) for r in trace.walk(spark.createDataFrame([("p", "base.ts")], "project string, path string"), spark.createDataFrame(rows, EDGES), files, ["clone"]).collect()}
    assert {(f"{n}.ts", "dispatch_override_chain", 58) for n in ("Line", "Mesh", "Points", "Sprite", "Bone")} <= got and ("supabase/functions/send/index.ts", "resolved_edge_function", 78) in got and not any(p == "x.ts" for p, _, _ in got)


def test_schedulers_contracts_and_roles(spark):
    edges = spark.createDataFrame([edge(1, source_path="a.ts", relation="invokes_edge_function", target_name="retry-mail"), edge(2, source_path="w.ts", relation="accesses_table", metadata='{"operation":"update"}'), edge(3, source_path="r.ts", relation="reads_table"), edge(4, source_path="c.ts", relation="calls_rpc", target_name="public.get_hours")], EDGES)
    texts = spark.createDataFrame(
        [("p", "db/s.sql", 1, 3, "select cron.schedule('x', 'retry-mail')", "schema_history"), ("p", "types.ts", 1, 2, "get_hours: unknown", "generated"), ("p", "src/u.tsx", 1, 2, "useQuery({ queryKey: ['k2'] }); rpc('get_hours')", "code"), ("p", "n.ts", 1, 1, None, "code")],
        "project string, path string, start_line int, end_line int, content string, authority string",
    )
    functions = spark.createDataFrame([("p", "retry-mail")], "project string, name string")
    got = {(r.path, r.kind): r.score for r in trace.schedulers(functions, edges, texts.where("path like '%.sql'")).collect()}
    assert got == {("a.ts", "edge_function_invoker"): 56, ("db/s.sql", "scheduler_lexical"): 70}
    names = spark.createDataFrame([("p", "get_hours"), ("p", "")], "project string, name string")
    assert [(r.path, r.score) for r in trace.generated_contracts(names, texts).collect()] == [("types.ts", 50)]
    assert [(r.path, r.keys) for r in trace.consumers(names.where("name <> ''"), texts).collect()] == [("src/u.tsx", "k2")]
    assert [(r.path, r.score) for r in trace.lexical_consumers(names, texts, ["hours"]).collect()] == [("src/u.tsx", 67)]
    assert [r.name for r in trace.relevant_procedures(names, edges, ["hours"]).collect()] == ["get_hours"]
    files = spark.createDataFrame([("p", x, a, "search_anchor") for x, a in (("w.ts", "code"), ("r.ts", "code"), ("c.ts", "test"), ("absence.ts", "code"))], "project string, path string, authority string, kinds string")
    roles = {r.path: r.roles for r in trace.file_roles(files, edges, "who may cancel, and how is the balance calculated?").collect()}
    assert roles == {"w.ts": "readers,writers", "r.ts": "readers", "c.ts": "rpc,tests", "absence.ts": "calculation,lifecycle"}
    evidence = files.join(spark.createDataFrame(list(roles.items()), "path string, roles string"), "path").withColumn("lane", F.when(F.col("authority") == "test", "tests").otherwise("implementation"))
    row = trace.coverage(evidence, "sql writers and tests").first()
    assert (row.lanes_missing, row.roles_missing) == ("constraints,persistence,retries,scheduling", "sql")
    got = {r.path: (r.categories, r.action, r.basis) for r in trace.impact(evidence, texts).collect()}
    assert got["w.ts"] == ("reader,writer", "likely_modify", "role_match") and got["c.ts"][0] == "integration,test"
    flow = trace.coverage(evidence, "sql writers and tests").withColumn("uninvalidated_keys", F.lit("k2")).withColumn("lineage_missing", F.lit("")).withColumn("facets_missing", F.lit("")).withColumn("consumers", F.lit(3)).withColumn("lineage_entries", F.lit(3)).withColumn("shared_consumers", F.lit(0))
    told = trace.reason_rows(files, 50, "search_anchor", "lexical")
    d = trace.diagnose(evidence, told, flow).first()
    assert d.quality == "weak" and d.warnings.split(",") == ["lexical_dominance", "thin_role_coverage", "missing_roles", "cache_review_required"] and d.strengths == "consumer_fanout,sql_lineage"
    assert (d.lane_counts, d.lexical_relation_ratio, d.dominant_lane_ratio, d.distinct_rpc_consumers) == ("implementation:3,tests:1", 1.0, 0.75, 3)
    assert trace.diagnose(evidence.limit(0), told.limit(0), flow).first().warnings.startswith("no_evidence")


def test_ranges_and_evidence(spark):
    lines = [f"line {k}" for k in range(1, 301)]
    rows = [chunk(k, "p", "f.ts", s, "\n".join(lines[s - 1 : s + 79])) for k, s in enumerate(range(1, 300, 65))]
    chunks = spark.createDataFrame([*rows, chunk(90, "p", "n.ts", 1, None)], CHUNKS)
    ranges = spark.createDataFrame([(1, "p", "f.ts", 50, 271), (2, "p", "f.ts", 295, 310), (3, "p", "n.ts", 1, 2)], "range_id int, project string, path string, start_line int, end_line int")
    got = {r.range_id: r for r in ledger.read_ranges(ranges, chunks).collect()}
    assert got[1].content.split("\n") == lines[49:271] and got[1].missing == 0 and (got[2].last_line, got[2].missing) == (300, 10) and 3 not in got
    symbols = spark.createDataFrame([symbol(1, path="f.ts", name="big", qualified_name="big", start_line=50, end_line=271), symbol(2, path="t.test.ts", name="bigWorks", qualified_name="bigWorks", start_line=1, end_line=2), symbol(3, path="f.ts", name="old", qualified_name="old", active=0)], SYMBOLS)
    edges = spark.createDataFrame([edge(7, source_path="t.test.ts", line=2, target_name="big", target_path="f.ts"), edge(8, source_path="g.ts", line=9, target_name="nobody", target_path=None)], EDGES)
    authority = spark.createDataFrame([("p", "f.ts", "code"), ("p", "t.test.ts", "test")], "project string, path string, authority string")
    files = spark.createDataFrame([("p", "f.ts"), ("p", "t.test.ts")], "project string, path string")
    asked = [("a", "range", "f.ts", None, 131, 210), ("b", "range", "f.ts", None, 131, 210), ("c", "symbol", None, "BIG", None, None), ("d", "callers", None, "big", None, None), ("e", "tests", None, "big", None, None), ("f", "range", "../x", None, 1, 2), ("g", "fly", None, "x", None, None), ("h", "symbol", None, "old", None, None), ("i", "range", "f.ts", None, 9, 2), ("j", "sql", None, "big", None, None)]
    requests = spark.createDataFrame([(r, "p", *x) for r, *x in asked], "request string, project string, op string, path string, name string, start_line int, end_line int")
    found, refused = ledger.resolve_requests(requests, symbols, edges, authority, files)
    opened = {(r.request, r.path, r.start_line, r.end_line, r.kind) for r in found.collect()}
    assert {("a", "f.ts", 50, 271, "symbol"), ("c", "f.ts", 50, 271, "symbol"), ("d", "t.test.ts", 1, 2, "symbol"), ("d", "f.ts", 50, 271, "symbol"), ("e", "t.test.ts", 1, 2, "symbol")} <= opened and not any(o[0] == "b" for o in opened)
    assert {r.request: r.reason for r in refused.collect()} == {"f": "invalid path", "g": "invalid op", "h": "no indexed match", "i": "invalid range", "j": "no indexed match"}
    shown = ledger.open_symbols(found.where("kind = 'symbol'").withColumnRenamed("symbol", "qualified_name"), chunks, "s", most_bytes=1000).collect()
    one = next(r for r in shown if r.path == "f.ts")
    assert not one.complete and one.end_line == 50 + 160 and one.content.count("\n") == 160 and one.evidence_id.startswith("V") and len([r for r in shown if r.path == "f.ts"]) == 1
    expanded = {(r.edge_id, r.path, r.kind) for r in ledger.expand_edges(edges.withColumn("edge_id", F.col("id")), symbols).collect()}
    assert expanded == {(7, "t.test.ts", "symbol"), (7, "f.ts", "symbol"), (8, "g.ts", "callsite")}


def test_answers():
    claim = {"claim_id": "x", "text": "t", "kind": "direct", "support": "support", "missing_evidence": "", "evidence_ids": ["V1", "V9"], "edge_ids": []}
    answer = {"snapshot_id": "s", "status": "answer", "answer": "yes", "inspect_edge_ids": ["E1"], "claims": [claim], "requests": [], "contradictions": [{"text": "c", "claim_ids": ["x", "gone"]}], "answer_claim_ids": ["x"]}
    with pytest.raises(ledger.ProtocolError):
        ledger.check_form(answer, {"snapshot_id": "s"}, {"E1"}, {"V1"})
    good = answer | {"claims": [claim | {"evidence_ids": ["V1"]}]}
    assert ledger.check_form(good, {"snapshot_id": "s"}, {"E1"}, {"V1"}) is good
    for bad in ({"status": "maybe"}, {"snapshot_id": "t"}, {"extra": 1}, {"inspect_edge_ids": ["E2"]}, {"claims": [claim, claim]}, {"requests": [{"op": "range"}]}):
        with pytest.raises(ledger.ProtocolError):
            ledger.check_form(good | bad, {"snapshot_id": "s"}, {"E1"}, {"V1"})
    got = ledger.check_references(answer, {"E1"}, {"V1"})
    assert got["status"] == "need_more" and got["claims"][0]["support"] == "unknown" and got["claims"][0]["evidence_ids"] == ["V1"] and got["claims"][0]["claim_id"] == ledger.claim_key("t", "direct")
    assert got["contradictions"][0]["claim_ids"] == [ledger.claim_key("t", "direct")] and len(got["invalid_references"]) == 2
    assert ledger.check_references(good, {"E1"}, {"V1"})["answer_claim_ids"] == [ledger.claim_key("t", "direct")]
    assert ledger.groups_of(7) == [5, 2] and ledger.groups_of(12) == [6, 6]
    sizes = []
    assert ledger.tree_reduce(list(range(37)), lambda g: sizes.append(len(g)) or sum(g)) == sum(range(37)) and min(sizes) >= 2 and max(sizes) <= 6
    with pytest.raises(ValueError):
        ledger.tree_reduce([], sum)
    assert ledger.in_batches([3, 3, 5, 1], sum, 6) == [[3, 3], [5, 1]]
    with pytest.raises(ValueError):
        ledger.in_batches([9], sum, 6)


def test_context_pieces(spark):
    schema = "place int, project string, path string, start_line int, end_line int"
    symbols = spark.createDataFrame([symbol(1, path="f.ts", name="retryCommand", qualified_name="retryCommand", start_line=10, end_line=19), symbol(2, path="f.ts", name="outer", kind="class", qualified_name="outer", start_line=1, end_line=100)], SYMBOLS)
    spans = spark.createDataFrame([(1, "p", "f.ts", 12, 14), (2, "p", "f.ts", 5, 15), (3, "p", "f.ts", 95, 105), (4, "p", "g.ts", 1, 2)], schema)
    assert {r.place: r.symbol for r in context.candidate_symbols(spans, symbols, ["retry"]).collect()} == {1: "retryCommand", 2: "outer"}
    assert {r.place for r in context.candidate_symbols(spans, symbols, ["outer"]).collect()} == {1, 2, 3}
    text = "\n".join("x" * 99 for _ in range(1000))
    first, last, shown, whole = context.bounded_source(text, 11, 500)
    assert not whole and len(shown) <= 18_000 and first <= 500 <= last and shown == "\n".join(text.split("\n")[first - 11 : last - 10])
    assert context.bounded_source("a\nb", 3, 3) == (3, 4, "a\nb", True) and context.bounded_source("y" * 20_000, 1, 1)[2] == "y" * 18_000
    hits = spark.createDataFrame([("q", 1, "p", "a", 1, 2, "x" * 20_000, 3.0), ("q", 2, "p", "b", 1, 2, "y" * 9000, 2.0), ("q", 3, "p", "c", 1, 2, "z", 1.0)], "question string, id bigint, project string, path string, start_line int, end_line int, content string, score double")
    assert [(r.id, r.place) for r in context.prompt_blocks(hits).collect()] == [(1, 1), (3, 2)]
    repos = spark.createDataFrame([("p", "c1", "g1")], "project string, commit_hash string, generation_id string")
    assert context.verified({"commit_hash": "c1"}, repos, "p")
    with pytest.raises(LookupError, match="refresh"):
        context.verified({"commit_hash": "c2"}, repos, "p")


def test_snapshots(spark):
    tables = {"chunks": spark.createDataFrame([chunk(1, "p", "a.ts", 1, "a")], CHUNKS), "symbols": spark.createDataFrame([symbol(1, generation_id="g")], SYMBOLS), "edges": spark.createDataFrame([edge(1, generation_id="g")], EDGES)}
    generation = tables["chunks"].first().generation_id
    tables["symbols"], tables["edges"] = (tables[t].withColumn("generation_id", F.lit(generation)) for t in ("symbols", "edges"))
    repos = spark.createDataFrame([("p", "c", generation)], "project string, commit_hash string, generation_id string")
    snapshot = publish.freeze("p", tables, repos)
    publish.still_current(snapshot, tables, repos)
    changed = tables | {"edges": tables["edges"].withColumn("line", F.lit(77))}
    with pytest.raises(ValueError, match="graph_digest"):
        publish.still_current(snapshot, changed, repos)
    with pytest.raises(ValueError, match="another generation"):
        publish.freeze("p", tables | {"edges": tables["edges"].withColumn("generation_id", F.lit("g2"))}, repos)
    shuffled = tables["edges"].unionByName(spark.createDataFrame([edge(2, line=5)], EDGES))
    assert publish.graph_digests(shuffled, tables["symbols"]).first().digest == publish.graph_digests(shuffled.orderBy(F.desc("id")), tables["symbols"]).first().digest


def test_atlas_in_full(spark):
    edges = spark.createDataFrame([edge(k, source_path=f"f{k % 3}.ts", line=k) for k in range(12)], EDGES)
    got = atlas.prefix_batches(edges, 25, F.lit(10)).collect()
    assert max(r.used for r in got) == 20 and {r.batch for r in got} == set(range(6)) and len(got) == 12
    with pytest.raises(Exception, match="exceeds the budget"):
        atlas.prefix_batches(edges, 5, F.lit(10)).collect()
    parts = atlas.encoded(edges)
    groups = parts["groups"].collect()
    assert sum(len(g.edges) for g in groups) == 12 and len(groups) == 3 and {r.value for r in parts["paths"].collect()} >= {"f0.ts", "f1.ts", "f2.ts"}


def test_streams(spark, tmp_path):
    store = ProjectStore(spark, str(tmp_path / "s"))
    source = tmp_path / "in"
    spark.createDataFrame([chunk(1, "p", "a.ts", 1, "a"), chunk(2, "q", "b.ts", 1, "b")], CHUNKS).write.parquet(str(source))
    refresh_projects(spark.readStream.schema(CHUNKS).parquet(str(source)), store, str(tmp_path / "c")).awaitTermination()
    before = store.snapshot("q")
    spark.createDataFrame([chunk(3, "p", "a.ts", 1, "changed")], CHUNKS).write.mode("append").parquet(str(source))
    refresh_projects(spark.readStream.schema(CHUNKS).parquet(str(source)), store, str(tmp_path / "c")).awaitTermination()
    assert [r.content for r in store.read("chunks", "p").collect()] == ["changed"] and store.snapshot("q") == before
    claims = tmp_path / "claims"
    schema = "text string, kind string, support string, evidence string"
    spark.createDataFrame([("t", "k", "unknown", "a"), ("t", "k", "support", "b"), ("u", "k", "refute", "c")], schema).write.parquet(str(claims))
    rows = []
    run = lambda: claim_stream(spark.readStream.schema(schema).parquet(str(claims))).writeStream.outputMode("update").foreachBatch(lambda df, n: rows.append({(r.support, r.evidence, r.contradicted) for r in df.collect()})).option("checkpointLocation", str(tmp_path / "cc")).trigger(availableNow=True).start().awaitTermination()
    run()
    spark.createDataFrame([("t", "k", "refute", "b")], schema).write.mode("append").parquet(str(claims))
    run()
    assert rows[0] == {("support", 2, 0), ("refute", 1, 0)} and rows[-1] == {("support", 2, 1)}


def test_conformed(spark):
    df = conformed(spark.createDataFrame([("7", "x")], "id string, other string"), CHUNKS)
    assert df.columns == ["id", "project", "path", "start_line", "end_line", "commit_hash", "generation_id", "content"] and df.first().id == 7 and df.first().content is None


def test_small_functions(spark, tmp_path):
    from quernstone.functions.code import matched_terms, metadata_object, name_tokens, strict_object
    from quernstone.operators.classify import authority_of, reason_of
    from quernstone.operators.files import file_texts
    from quernstone.operators.graph import scoped_cache_audit
    from quernstone.sources.extracted import read_extracted

    df = spark.createDataFrame([('{"b":1,"a":2}',), ("[1]",), ("no",), (None,), ('```json\n{"x": 1}\n```',), ('{"x":1,"x":2}',), ('{"x": NaN}',)], "m string")
    got = [(r.o, r.s) for r in df.select(metadata_object(F.col("m")).alias("o"), strict_object(F.col("m")).isNotNull().alias("s")).collect()]
    assert got[:4] == [('{"a":2,"b":1}', True), ('{"value":[1]}', False), ('{"raw":"no"}', False), ("{}", False)] and [s for _, s in got[4:]] == [True, False, False]
    row = spark.range(1).select(matched_terms(F.lit("src/Retry.ts"), F.lit("OUTBOX"), ["retry", "outbox", "x9"]).alias("t"), name_tokens(F.lit("public.guest_stay_ab")).alias("n"), authority_of(F.lit("docs/history/a.md")).alias("a"), reason_of(F.lit("docs/history/a.md")).alias("r"), reason_of(F.lit(None).cast("string")).alias("none")).first()
    assert (row.t, row.n, row.a, row.r, row.none) == (["outbox", "retry"], ["public", "guest", "stay"], "historical", "history folder", None)
    chunks = spark.createDataFrame([chunk(2, "p", "a.ts", 3, "b"), chunk(1, "p", "a.ts", 1, "a"), chunk(3, "p", "n.ts", 1, None), chunk(4, "p", "u.ts", 1, "queryKey: ['k']; queryKey: ['l']"), chunk(5, "p", "h.ts", 1, "invalidateQueries({ queryKey: ['k'] })"), chunk(6, "p", "far.ts", 1, "invalidateQueries({ queryKey: ['l'] })")], CHUNKS)
    assert {r.path: r.text for r in file_texts(chunks).collect()}["a.ts"] == "a\nb"
    imports = spark.createDataFrame([("p", "u.ts", "h.ts")], "project string, source_path string, target_path string")
    assert [r.key for r in scoped_cache_audit(chunks, spark.createDataFrame([("p", "u.ts")], "project string, path string"), imports).collect()] == ["l"]
    (tmp_path / "s.json").write_text('{"project":"p","path":"a.ts","kind":"function","name":"f","start_line":1,"end_line":2,"signature":"' + "x" * 600 + '"}\n{"name":""}\nbroken\n')
    (tmp_path / "e.json").write_text('{"project":"p","source_path":"a.ts","source_name":"f","relation":"calls","target_name":"g","line":2,"metadata":{"n":1}}\n{"target_name":""}\n')
    graph = read_extracted(spark, str(tmp_path / "s.json"), str(tmp_path / "e.json"))
    s, e = graph["symbols"].collect(), graph["edges"].collect()
    assert len(s) == 1 and (s[0].qualified_name, s[0].active, len(s[0].signature)) == ("f", 1, 500)
    assert len(e) == 1 and (e[0].source_qualified_name, e[0].resolution_confidence, e[0].metadata) == ("f", "unresolved", '{"n":1}')


def hit(rank, path, start=1, end=40, content="x", authority="code"):
    return (rank, "p", path, start, end, content, authority, 1.0 - rank / 100)


HIT = "rank int, project string, path string, start_line int, end_line int, content string, authority string, score double"


def test_hints_on_hits(spark):
    """Callers of a callee that the question names, elsewhere; what an anchor calls; where contracts differ."""
    calls = [("lib/defaults.js", "transformRequest", 12, "isFormData"), ("lib/defaults.js", "transformRequest", 13, "isBlob"), ("lib/defaults.js", "transformRequest", 14, "isFile"), ("lib/http.js", "dispatchHttp", 22, "isFormData"), ("lib/http.js", "dispatchHttp", 24, "isStream"), ("test/utils.js", "check", 5, "isFormData")]
    edges = spark.createDataFrame([edge(k, source_path=p, source_name=n, source_qualified_name=n, line=at, target_name=t, target_path="lib/utils.js") for k, (p, n, at, t) in enumerate(calls)] + [edge(99, source_path="lib/far.js", target_name="isFormData", target_path="lib/utils.js", resolution_confidence="unresolved")], EDGES)
    symbols = spark.createDataFrame([symbol(1, path="lib/defaults.js", name="transformRequest", qualified_name="transformRequest", start_line=10, end_line=40), symbol(2, path="lib/http.js", name="dispatchHttp", qualified_name="dispatchHttp", start_line=20, end_line=60), symbol(3, path="lib/http.js", kind="module", name="http", qualified_name="http", start_line=1, end_line=90)], SYMBOLS)
    chunks = spark.createDataFrame([chunk(1, "p", "lib/http.js", 15, "\n".join(["dispatch of FormData"] * 30)), chunk(2, "p", "test/utils.js", 1, "\n".join(["check"] * 9)), chunk(3, "p", "lib/far.js", 1, "x")], CHUNKS)
    authority = spark.createDataFrame([("p", "lib/http.js", "code"), ("p", "test/utils.js", "test"), ("p", "lib/far.js", "code")], "project string, path string, authority string")
    hits = spark.createDataFrame([hit(0, "lib/defaults.js", 10, 30), hit(1, "docs.md", authority="active")], HIT)
    question = "How does the node adapter dispatch requests with FormData bodies?"
    found = hints.relationship_hints(question, hits, symbols, edges, chunks, authority, 2)
    got = [(r.path, r.via, r.from_path) for r in found.collect()]
    assert got == [("lib/http.js", "isFormData", "lib/defaults.js"), ("test/utils.js", "isFormData", "lib/defaults.js")]
    assert hints.relationship_hints("the of", hits, symbols, edges, chunks, authority).count() == 0
    anchors = hints.anchor_relationships(hits, symbols, edges).collect()
    assert [(r.path, r.symbol, r.calls) for r in anchors] == [("lib/defaults.js", "transformRequest", "isFormData,isBlob,isFile")]
    c = hints.hit_contracts(hits, found, symbols, edges).collect()
    assert [(r.anchor, r.related, r.shared, r.only_anchor, r.only_related) for r in c] == [("transformRequest", "dispatchHttp", "isFormData", "isBlob,isFile", "isStream")]
    assert hints.hit_contracts(hits, found.where("path = 'x'"), symbols, edges).count() == 0


def test_symbol_cards(spark):
    """An exact definition wins over homonyms and longer names; relations of other files' homonyms are left out."""
    symbols = spark.createDataFrame([symbol(1, path="a.ts", name="lock", qualified_name="Guest.lock"), symbol(2, path="b.ts", name="lock", qualified_name="Room.lock"), symbol(3, path="c.ts", name="lockAll", qualified_name="lockAll")], SYMBOLS)
    edges = spark.createDataFrame([edge(k, source_path="a.ts", source_name="lock", source_qualified_name="Guest.lock", target_name=f"f{k}", line=k) for k in range(5)] + [edge(8, source_path="b.ts", source_name="lock", source_qualified_name="Room.lock", target_name="other"), edge(9, source_path="z.ts", source_name="user", target_name="lock", target_qualified_name="Guest.lock", target_path="a.ts")], EDGES)
    rows = hints.symbol_card(symbols, edges, "guest.lock", 2).collect()
    parts = {p: [r.name for r in rows if r.part == p] for p in {r.part for r in rows}}
    assert parts["definition"] == ["Guest.lock"] and len(parts["call"]) == 5 and len(parts["outgoing"]) + len(parts.get("incoming", [])) == 2 and "other" not in parts["call"]
    both = hints.symbol_card(symbols, edges, "lock", 50).collect()
    assert {r.name for r in both if r.part == "definition"} == {"Guest.lock", "Room.lock"} and {r.name for r in both if r.part == "alternative"} == {"lockAll"}
    assert {r.name for r in hints.symbol_card(symbols, edges, "lock", 50, "b.ts").collect() if r.part == "definition"} == {"Room.lock"}
    assert hints.symbol_card(symbols, edges, "nobody", 5).count() == 0


def test_index_follows_changes(spark, tmp_path):
    from quernstone.operators import index
    from quernstone.operators.lexical import bm25

    old = spark.createDataFrame([chunk(1, "p", "same.ts", 1, "retry outbox"), chunk(2, "p", "gone.ts", 1, "retry gone"), chunk(3, "p", "n.ts", 1, None)], CHUNKS)
    new = spark.createDataFrame([chunk(7, "p", "same.ts", 1, "retry outbox"), chunk(8, "p", "new.ts", 1, "retry retry fresh"), chunk(9, "p", "n.ts", 1, None)], CHUNKS)
    now = index.changed_index(index.postings(old), old, new)
    index.write_index(now, str(tmp_path / "i"))
    stored = index.read_index(spark, str(tmp_path / "i"))
    kept = new.withColumn("id", F.when(F.col("id") == 7, 1).when(F.col("id") == 9, 3).otherwise(F.col("id")))
    want = {r.id: round(r.score, 9) for r in bm25(kept, ["retry", "fresh", "ts"]).collect()}
    assert {r.id: round(r.score, 9) for r in index.search_index(stored, index.index_statistics(stored), ["retry", "fresh", "ts"]).collect()} == want and set(want) == {1, 3, 8}
    with pytest.raises(ValueError):
        index.search_index(stored, index.index_statistics(stored), [])
    assert index.postings(old.limit(0)).count() == 0
