import math

import pytest
from pyspark.sql import functions as F

from quernstone.functions.text import active_intents, query_terms
from quernstone.operators import atlas, classify, context, extract, files, fusion, graph, lexical, publish, results, skew, vector
from quernstone.operators.chunking import line_windows, token_estimate
from quernstone.sources.registry import Registry
from quernstone.sources.store import GenerationStore
from quernstone.sources.tree import scan_tree
from quernstone.streaming.refresh import merge_chunks, refresh_stream
from quernstone.tables import CHUNK_EMBEDDINGS, CHUNKS, EDGES, SYMBOLS


def chunk(i, project, path, start, text, generation="g"):
    end = None if text is None else start + text.count("\n")
    return (i, project, path, start, end, "c", generation, text)


def edge(i, **own):
    base = dict(project="p", source_path="a.ts", source_name="f", relation="calls", target_name="g", target_path=None, line=1, metadata="{}", source_qualified_name="f", target_qualified_name=None, resolution_confidence="exact_path", commit_hash="c", generation_id="g")
    return (i, *(base | own).values())


def symbol(i, **own):
    base = dict(project="p", path="a.ts", kind="function", name="f", qualified_name="f", start_line=1, end_line=9, signature="", active=1, metadata="{}", commit_hash="c", generation_id="g")
    return (i, *(base | own).values())


# -- text and classes
def test_query_terms():
    terms = query_terms("¿Cómo se calcula el saldo de vacaciones?")
    assert not any("?" in t for t in terms) and {"vacation", "balance"} <= set(terms)
    terms = query_terms("Si el proveedor falla, ¿qué respuesta llega?")
    assert {"reconcile", "idempotency", "command"} <= set(terms) and "reliability" in active_intents("La conexión falla")
    late = query_terms(" ".join(f"word{i}" for i in range(55)) + " FormData Blob ArrayBuffer Content-Length")
    assert len(late) == 48 and {"formdata", "blob", "arraybuffer", "content-length"} <= set(late)


def test_authority(spark):
    want = {
        "README.md": "active", "CHANGELOG.md": "historical", "test/unit/adapters/http.js": "test", "test/module/package.json": "config", "package.json": "config", "lib/adapters/http.js": "code",
        "docs/history/old.md": "historical", "functions/helper_test.ts": "test", "db/migrations/1_a.sql": "schema_history", "docs/architecture/x.md": "canonical", "x/agents.md": "canonical", ".github/w.yml": "active", None: None,
    }
    df = spark.createDataFrame([(p,) for p in want], "path string").select("path", classify.authority_of(F.col("path")).alias("a"))
    assert {r.path: r.a for r in df.collect()} == want


def test_path_predicates(spark):
    df = spark.createDataFrame([(".env",), ("config/private.key",), ("src/config.ts",), ("../x.ts",), ("node_modules/a.js",), ("package-lock.json",)], "path string")
    p = F.col("path")
    got = {r[0]: tuple(r[1:]) for r in df.select(p, classify.is_secret_path(p), classify.is_safe_path(p), classify.is_indexable_path(p)).collect()}
    assert got[".env"] == (True, True, False) and got["config/private.key"][0] and got["src/config.ts"] == (False, True, True)
    assert not got["../x.ts"][1] and not got["node_modules/a.js"][2] and not got["package-lock.json"][2]


# -- windows and files
def test_line_windows(spark):
    text = "\n".join(f"line {i}" for i in range(1, 121))
    df = spark.createDataFrame([("a", text, 7), ("b", None, 7), ("c", "", 7), ("d", "one\n", 7)], "path string, content string, start_line int")
    got = {}
    for r in line_windows(df, size=50, overlap=10).collect():
        got.setdefault(r.path, []).append((r.start_line, r.end_line))
    assert got == {"a": [(1, 50), (41, 90), (81, 120)], "d": [(1, 1)]}
    with pytest.raises(ValueError):
        line_windows(df, size=5, overlap=5)
    assert spark.range(1).select(token_estimate(F.lit(0)).alias("t"), token_estimate(F.lit(9)).alias("u")).first() == (1, 3)


def test_windows_make_whole_files(spark):
    lines = [f"l{i}" for i in range(1, 301)]
    rows = [chunk(k, "p", "f.py", s, "\n".join(lines[s - 1 : s + 79])) for k, s in enumerate(range(1, 300, 65))]
    rows += rows[:2] + [chunk(90, "p", "f.py", 1, rows[0][7], "old"), chunk(91, "p", "n.py", 1, None), (92, None, "x.py", 1, 1, "c", "g", "x"), (93, "p", "e.py", None, None, "c", "g", "")]
    df = spark.createDataFrame(rows, CHUNKS)
    for block_lines in (4096, 100, 7):
        parts = {}
        for r in files.windows_by_block(df, block_lines).collect():
            first, text = files.join_windows(list(r.starts), list(r.texts), r.block, block_lines)
            assert first == r.block * block_lines + 1
            parts.setdefault(r.path, []).append((first, text))
        assert "\n".join(t for _, t in sorted(parts["f.py"])) == "\n".join(lines)
        assert parts["e.py"] == [(1, "")] and set(parts) == {"f.py", "e.py"}
    assert files.windows_by_block(spark.createDataFrame([], CHUNKS)).count() == 0


def test_a_long_window_is_shuffled_once(spark):
    text = "\n".join(f"line {i}" for i in range(1, 30_001))
    df = spark.createDataFrame([chunk(1, "p", "a.py", 1, text), chunk(2, "p", "a.py", 90, "other\nother")], CHUNKS)
    rows = sorted(files.windows_by_block(df).collect(), key=lambda r: r.block)
    assert len(rows) == 8 and sum(len(t) for r in rows for t in r.texts) < len(text) + 100
    assert "\n".join(files.join_windows(list(r.starts), list(r.texts), r.block)[1] for r in rows) == text


# -- skew
def test_tree_aggregate(spark):
    rows = spark.range(10_000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("key"), (F.col("id") % 97).alias("v"), "id", F.lit(1).alias("__piece"))
    measures = [skew.count_rows(), skew.minimum("v", "low"), skew.maximum("v", "high"), skew.total("v", "sum"), skew.distinct_estimate("v", "kinds")]
    for chunks, fan_in in ((1, 2), (5, 2), (300, 16)):
        got = {r.key: tuple(r)[1:5] for r in skew.tree_aggregate(rows, ["key"], measures, chunks, F.xxhash64("id"), fan_in).collect()}
        want = {r.key: tuple(r)[1:] for r in rows.groupBy("key").agg(F.count(F.lit(1)), F.min("v"), F.max("v"), F.sum("v")).collect()}
        assert got == want and None in got
    assert skew.levels(300, 16) == [19, 2, 1] and skew.levels(1, 16) == [] and skew.chunks_for(0) == 1
    assert skew.tree_aggregate(rows.limit(0), ["key"], measures, 4, F.xxhash64("id")).count() == 0
    with pytest.raises(ValueError):
        skew.tree_aggregate(rows, ["key"], measures, 0, F.lit(0))


def test_heavy_keys(spark):
    rows = [(i, "hot" if i % 2 else f"p{i}", "t") for i in range(100)] + [(1, "hot", "t")] * 50 + [(None, None, None)] * 100
    df = spark.createDataFrame(rows, "id bigint, project string, target_name string").withColumn("n", F.lit(0))
    got = {(r.field, r.key_value): r.n for r in skew.heavy_keys(df, "id", ["project", "target_name"], 0.1, chunk_rows=7).collect()}
    assert got == {("project", "hot"): 50, ("target_name", "t"): 100}
    assert skew.heavy_keys(df.limit(0), "id", ["project"], 0.03).count() == 0
    # The share itself counts.
    exact = spark.createDataFrame([(i, "a" if i < 3 else f"b{i}") for i in range(100)], "id bigint, project string")
    assert [r.key_value for r in skew.heavy_keys(exact, "id", ["project"], 0.03).collect()] == ["a"]


# -- retrieval
def test_bm25_and_frequencies(spark):
    df = spark.createDataFrame([(1, "a/retry.ts", "retry the outbox"), (2, "b.ts", "nothing here"), (3, "c.ts", None), (4, "d.ts", "retry retry Qué")], "id bigint, path string, content string")
    got = {r.id: r.score for r in lexical.bm25(df, ["retry", "retry", "que"]).collect()}
    assert set(got) == {1, 4} and all(s > 0 for s in got.values())
    assert lexical.bm25(df, []).count() == 0 and lexical.bm25(df.limit(0), ["x"]).count() == 0
    freq = {r.term: (r.documents, r.occurrences) for r in lexical.token_frequencies(df).collect()}
    assert freq["retry"] == (2, 3) and freq["que"] == (1, 1)


def test_vectors(spark):
    nan = float("nan")
    rows = [(1, "m", 2, [3.0, 0.0], None), (2, "m", 2, [1.0, 1.0], None), (3, "m", 2, [nan, 1.0], None), (4, "m", 2, [0.0, 0.0], None), (5, "m", 2, None, None), (6, "m", 2, [1.0], None), (7, "m", 2, [0.0, 2.0], None)]
    df = spark.createDataFrame(rows, CHUNK_EMBEDDINGS).where(vector.usable(F.col("vector"), F.col("dimension")))
    got = [(r.chunk_id, r.score) for r in vector.exact_top(df, [2.0, 0.0], 5).collect()]
    assert got == [(1, 1.0), (2, round(math.sqrt(0.5), 5)), (7, 0.0)]
    chunks = spark.createDataFrame([(i, "p") for i in range(20)], "id bigint, project string")
    have = spark.createDataFrame([(i, "m", 2, [1.0, 0.0], None) for i in range(19)] * 2, CHUNK_EMBEDDINGS)
    row = vector.semantic_status(chunks, have, "m").first()
    assert (row.pending, row.recommendation) == (1, "defer") and [r.id for r in vector.backlog(chunks, have, "m").collect()] == [19]


def test_fusion(spark):
    a = spark.createDataFrame([(1, 5.0), (2, 4.0)], "id bigint, score double")
    b = spark.createDataFrame([(2, 0.9), (3, 0.8)], "id bigint, score double")
    got = {r.id: r.score for r in fusion.reciprocal_ranks(a, b, "id").collect()}
    assert got[2] == pytest.approx(1 / 62 + 0.9 / 61) and got[1] == pytest.approx(1 / 61) and got[3] == pytest.approx(0.9 / 62)
    hits = spark.createDataFrame([(1, 0.2, 0.1), (2, 0.1, 0.9)], "id bigint, base double, second double")
    best = fusion.rerank(hits, "id", "base", "second").orderBy(F.desc("score")).first()
    assert best.id == 2
    paths = spark.createDataFrame([("functions/retry-commands/index.ts", "retry"), ("src/data/competitors.ts", "x")], "path string, content string")
    m = fusion.retrieval_multiplier("El proveedor falla", F.col("path"), F.col("content"), F.lit("code"))
    first, second = [r[0] for r in paths.select(m).collect()]
    assert first > second


def test_snippets_and_diversity(spark):
    text = "\n".join(f"filler {i}" if i != 25 else "the dead_letter phrase" for i in range(1, 41))
    df = spark.createDataFrame([(1, 1, text), (2, 1, None)], "id bigint, start_line int, content string")
    best = results.best_lines(df, ["dead_letter"])
    assert [(r.id, r.line) for r in best.collect()] == [(1, 25)]
    s = results.snippets(df, best).first()
    assert "dead_letter" in s.snippet and s.snippet.count("\n") == 13
    hits = [("q", i, "p", "same.ts" if i < 6 else f"f{i}.ts", 1 + 10 * i, 5 + 10 * i, 100.0 - i) for i in range(10)] + [("r", 99, "p", "z", 1, 2, 1.0)]
    df = spark.createDataFrame(hits, "question string, id bigint, project string, path string, start_line int, end_line int, score double")
    got = [r for r in results.diverse_hits(df, 6).collect()]
    q = [r.id for r in got if r.question == "q"]
    assert len(q) == 6 and len([i for i in q if i < 6]) == 2 and q == sorted(q) and [r.id for r in got if r.question == "r"] == [99]


def test_pack_skips_and_goes_on(spark):
    rows = [("q", 1, "a", 1, 10, 9.0, 5000), ("q", 2, "b", 1, 10, 8.0, 9000), ("q", 3, "c", 1, 10, 7.0, 3000), ("q", 4, "a", 5, 12, 6.0, 10)]
    df = spark.createDataFrame(rows, "question string, id bigint, path string, start_line int, end_line int, priority double, tokens bigint")
    assert {r.id: r.fate for r in results.pack(df, 12_000).collect()} == {1: "included", 2: "token_budget", 3: "included", 4: "overlap"}


def test_fuzzy(spark):
    df = spark.createDataFrame([symbol(1, name="withGuestLock"), symbol(2, name="other"), symbol(3, name=None)], SYMBOLS)
    assert [r.name for r in results.similar_names(df, "withGuestLok").collect()] == ["withGuestLock"]


def test_candidates(spark):
    schema = "project string, path string, start_line int, end_line int, rank int"
    hit = spark.createDataFrame([("p", "a/retry.ts", 1, 9, 3), ("p", None, 1, 1, 0)], schema)
    anchor = spark.createDataFrame([("p", "a/retry.ts", 1, 9, 0), ("p", "b.ts", None, 2, 0)], schema)
    got = {(r.path, r.start_line): (r.priority, r.reasons) for r in context.fuse_candidates({"hit": hit, "anchor": anchor}, ["retry"]).collect()}
    assert got == {("a/retry.ts", 1): (1980, "anchor,hit"), ("b.ts", 1): (1820, "anchor")}


# -- graph
def test_latest_definition_and_targets(spark):
    rows = [symbol(1, name="hours", qualified_name="public.hours", path="db/migrations/20260101_old.sql"), symbol(2, name="Hours", qualified_name="public.hours", path="db/migrations/20260201_new.sql")]
    marked = graph.latest_definitions(spark.createDataFrame(rows, SYMBOLS), "db/migrations/")
    assert {r.id: r.active for r in marked.collect()} == {1: 0, 2: 1}
    edges = spark.createDataFrame([edge(1, relation="calls_rpc", target_name="public.hours"), edge(2, relation="calls_rpc", target_name="nobody"), edge(3)], EDGES)
    got = {r.id: r.target_path for r in graph.resolve_targets(edges, marked).collect()}
    assert got == {1: "db/migrations/20260201_new.sql", 2: None}


def test_expand_and_neighbours(spark):
    links = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "a")]
    edges = spark.createDataFrame([edge(i, source_path=s, target_path=t) for i, (s, t) in enumerate(links)] + [edge(9, source_path="a", target_path="z", resolution_confidence="unresolved")], EDGES)
    got = {r.path: r.score for r in graph.expand(spark.createDataFrame([("p", "a")], "project string, path string"), edges).collect()}
    assert got == {"a": 100, "b": 62, "x": 58, "c": 50}


def test_covering_and_contracts(spark):
    symbols = spark.createDataFrame([symbol(1, start_line=1, end_line=100), symbol(2, start_line=10, end_line=20, name="inner"), symbol(3, kind="module", start_line=1, end_line=999)], SYMBOLS)
    spans = spark.createDataFrame([(7, "p", "a.ts", 12, 18), (8, "p", "b.ts", 1, 2)], "span_id bigint, project string, path string, start_line int, end_line int")
    assert [(r.span_id, r.name) for r in graph.covering_symbols(spans, symbols).collect()] == [(7, "inner")]
    calls = {"l": ["isFormData", "isBlob", "isFile"], "r": ["isFormData", "isStream"]}
    edges = spark.createDataFrame([edge(i, source_qualified_name=q, target_name=t) for i, (q, t) in enumerate((q, t) for q, ts in calls.items() for t in ts)], EDGES)
    r = graph.contract_differences(edges).first()
    assert (r.shared, r.only_left, r.only_right) == ("isFormData", "isBlob,isFile", "isStream")


def test_cache_keys(spark):
    used = "useQuery({ queryKey: ['hours'] }); useQuery({queryKey: [\"x\"]}); client.invalidateQueries({ queryKey: ['x'] })"
    df = spark.createDataFrame([chunk(1, "p", "a.ts", 1, used), chunk(2, "p", "b.ts", 1, None)], CHUNKS)
    assert [r.key for r in graph.cache_key_audit(df).collect()] == ["hours"]


# -- publishing
def test_publish_diff(spark):
    old = spark.createDataFrame([chunk(1, "p", "same.ts", 1, "a"), chunk(2, "p", "changed.ts", 1, "before"), chunk(3, "p", "same.ts", 1, "a"), chunk(4, "p", "n.ts", 1, None)], CHUNKS)
    new = spark.createDataFrame([chunk(8, "p", "same.ts", 1, "a"), chunk(9, "p", "changed.ts", 1, "after"), chunk(7, "p", "n.ts", 1, None)], CHUNKS)
    got = sorted((r.path, r.change, r.old_id) for r in publish.publish_diff(old, new).select("path", "change", F.coalesce("old_id", F.lit(0)).alias("old_id")).collect())
    assert got == [("changed.ts", "deleted", 2), ("changed.ts", "inserted", 0), ("n.ts", "kept", 4), ("same.ts", "deleted", 3), ("same.ts", "kept", 1)]
    assert publish.publish_diff(old, old).where("change <> 'kept'").count() == 0


def test_atlas(spark):
    edges = spark.createDataFrame([edge(i, source_path=f"f{i % 3}.ts") for i in range(30)] + [edge(0, source_path="f0.ts")], EDGES)
    batches = atlas.batches_by_cost(edges, 50, F.lit(10))
    assert atlas.ownership_errors(edges, batches).count() == 0
    assert batches.groupBy("batch").count().agg(F.max("count")).first()[0] == 5
    assert {(r.id, r.times) for r in atlas.ownership_errors(edges, batches.where("id <> 4").union(batches.where("id = 5"))).collect()} == {(4, 0), (5, 2)}
    codes = {r.value: r.code for r in atlas.dictionary(spark.createDataFrame([(f"v{i:03d}",) for i in range(50)], "v string"), "v", "S").collect()}
    assert codes["v000"] == "S0" and codes["v035"] == "Sz" and codes["v036"] == "S10" and len(set(codes.values())) == 50


def test_claims(spark):
    rows = [(1, "t", "k", "unknown", "a"), (2, "t", "k", "support", "b"), (3, "t", "k", "refute", "b"), (1, "u", "k", "unknown", "a")]
    got = sorted((r.support, r.evidence, r.contradicted) for r in atlas.merge_claims(spark.createDataFrame(rows, "at int, text string, kind string, support string, evidence string")).collect())
    assert got == [("support", 2, 1), ("unknown", 1, 0)]


# -- extraction
def test_sql_extraction():
    text = "CREATE OR REPLACE FUNCTION public.f(a int) RETURNS int LANGUAGE plpgsql AS $$\nBEGIN\n  UPDATE t SET x = 1;\n  PERFORM public.g(a);\nEND;\n$$;\nCREATE TABLE u (\n id int\n);\ncreate policy \"own rows\" on u using (h(id));\n"
    symbols, edges = extract.extract_sql(text)
    assert ("function", "public.f", "public.f", 1, 6) in [s[:5] for s in symbols] and ("table", "u", "u", 7, 9) in [s[:5] for s in symbols]
    assert next(s for s in symbols if s[0] == "policy")[1::5] == ("own rows", '{"table":"u"}')
    assert ("public.f", "public.f", "accesses_table", "t", "t", "", 3, '{"operation":"update"}', "lexical") in edges and ("public.f", "public.f", "calls_sql", "public.g", "public.g", "", 4, "{}", "lexical") in edges
    assert any(e[0] == "own rows" and e[3] == "h" for e in edges)


SCRIPT = '''import Shared, { a, b as c } from "./lib";
import * as ns from "@/x/y";
import { gone } from "pkg";
class Base {
  get(x) { return this.load(x); }
  load(x) { return a(x, [1, 2]); }
}
export class A extends Base {
  constructor() { super(); }
  get(x) {
    return c(x) + ns.go(1, 2) + gone();
  }
}
class B extends Shared {
  set value(v) { this.lost(v); }
}
export const useThing = (p) => {
  // dead(1)
  const s = "dead(2)";
  register(function inner(q) { return helper(q); });
  return db.from("rows").insert({ x: 1 });
};
const Card = ({ row }) => { return draw(row); };
export async function load() {
  await client.functions.invoke("send-mail", {});
  return db.rpc("hours", {});
}
function helper(z) { return new Foo(z); }
'''


def test_script_extraction(spark):
    symbols, edges = extract.extract_script(SCRIPT, "src/app/m.ts")
    names = {(s[0], s[2], s[3], s[4]) for s in symbols}
    assert names >= {("module", "src/app/m.ts", 1, 29), ("class", "A", 8, 13), ("method", "A.get", 10, 12), ("method", "Base.get", 5, 5), ("method", "A.constructor", 9, 9), ("hook", "useThing", 17, 22), ("function", "useThing.inner", 20, 20), ("component", "Card", 23, 23), ("function", "load", 24, 27), ("method", "B.value", 15, 15)}
    calls = {(e[1], e[2], e[4], e[8]) for e in edges}
    assert calls >= {
        ("A", "extends", "Base", "same_file_inheritance"), ("A.get", "overrides", "Base.get", "same_file_inheritance"), ("B.value", "overrides", "Shared.value", "import_resolved_inheritance"),
        ("Base.get", "calls", "Base.load", "same_file"), ("A.get", "calls", "b", "import_resolved"), ("A.get", "calls", "go", "import_resolved"), ("B.value", "calls", "lost", "same_class_unresolved"), ("useThing.inner", "calls", "helper", "same_file"),
        ("useThing", "writes_table", "public.rows", "literal"), ("load", "calls_rpc", "public.hours", "literal"), ("load", "invokes_edge_function", "send-mail", "literal"),
    }
    assert not any(e[3] in ("dead", "Foo", "rpc", "insert") for e in edges)
    one = next(e for e in edges if e[3] == "a")
    assert one[7] == '{"argument_count":2,"call_kind":"identifier","expression":"a","optional_chain":false,"receiver":"a"}'
    df = spark.createDataFrame([chunk(1, "p", "src/app/m.ts", 1, SCRIPT), chunk(2, "p", "src/app/lib/index.ts", 1, "export const a = 1;"), chunk(3, "p", "n.ts", 1, None), chunk(4, "p", "src/x/y.js", 1, "export const go = () => { return 1 };"), chunk(5, "p", "db/migrations/1.sql", 1, "create function public.hours() returns int as $$ select 1 $$ language sql;")], CHUNKS)
    assert {(r.via, r.target_path) for r in extract.resolve_imports(extract.extract_edges(df), df).collect()} == {("./lib", "src/app/lib/index.ts"), ("@/x/y", "src/x/y.js")}
    graph_ = extract.build_graph(df)
    got = {(r.relation, r.target_name, r.target_path, r.resolution_confidence) for r in graph_["edges"].collect()}
    assert got >= {("imports", "./lib", "src/app/lib/index.ts", "exact_path"), ("imports", "pkg", None, "external_or_unresolved"), ("calls", "gone", None, "external_import"), ("calls", "go", "src/x/y.js", "import_resolved"), ("extends", "Shared", "src/app/lib/index.ts", "import_resolved_inheritance"), ("calls_rpc", "public.hours", "db/migrations/1.sql", "active_sql")}
    row = extract.graph_statistics(graph_["symbols"], graph_["edges"]).first()
    assert row.symbols == graph_["symbols"].count() and row.edges == graph_["edges"].count() and row.unresolved == 2 and row.module_owned == 3
    assert graph_["symbols"].select("id").distinct().count() == row.symbols
    assert {c for c in graph_["edges"].columns} >= {"id", "project", "source_path", "source_name", "relation", "target_name", "target_path", "line", "metadata", "source_qualified_name", "target_qualified_name", "resolution_confidence", "commit_hash", "generation_id"}


def test_import_paths(spark):
    rows = [("src/a/b.ts", "../c", "src/c"), ("src/a/b.ts", "./c/../d", "src/a/d"), ("b.ts", "./c", "c"), ("b.ts", "../c", "../c"), ("src/a/b.ts", "@/x", "src/x"), ("src/a/b.ts", "react", None), ("a/b/c/d.ts", "../../x/y", "a/x/y")]
    df = spark.createDataFrame(rows, "path string, via string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", extract.import_base(F.col("path"), F.col("via"))).collect())


def test_extraction_of_long_files(spark):
    """A file of several blocks gives what extracting its text as a whole gives."""
    script = 'import { a } from "./lib";\nexport function near() {\n  return a(1);\n}\nexport function wide() {\n' + "  a(2);\n" * 9000 + "}\nexport function far() {\n  return near() + a(3);\n}\n"
    sql = "create table t (\n" + "  a int,\n" * 5000 + "  b int\n);\ncreate function f() returns int as $$\n" + "select 1;\n" * 5000 + "select g(1) from t;\n$$ language sql;\n"
    lines = {"x.ts": script.split("\n"), "y.sql": sql.split("\n")}
    rows = [chunk(k * 1000 + at, "p", path, at + 1, "\n".join(own[at : at + 120])) for k, (path, own) in enumerate(lines.items()) for at in range(0, len(own), 100)]
    df = spark.createDataFrame(rows, CHUNKS)
    want = [extract.extract_script(script, "x.ts"), extract.extract_sql(sql)]
    symbols = sorted(tuple(r)[1:] for r in extract.extract_symbols(df).collect())
    assert symbols == sorted((path, *s) for path, (own, _) in zip(lines, want) for s in own)
    assert {(s[2], s[4], s[5]) for s in symbols} >= {("wide", 5, 9006), ("far", 9007, 9009), ("f", 5004, 10006)} and [s[1] for s in symbols].count("module") == 1
    edges = sorted((tuple(r)[1:] for r in extract.extract_edges(df).collect()), key=str)
    assert edges == sorted(((path, *e) for path, (_, own) in zip(lines, want) for e in own), key=str)
    assert {("wide", "a", 9005, "import_resolved"), ("far", "near", 9008, "same_file"), ("f", "g", 10005, "lexical")} <= {(e[1], e[4], e[7], e[9]) for e in edges}


# -- sources and streams
def test_scan_tree(spark, tmp_path):
    for name, data in {"tracked.ts": b"const a = 1;", "sub/new.md": b"# x", ".env": b"A=1", "bad.ts": b"\xff\xfe\x00", "node_modules/m.js": b"x", "notes.bin": b"x", "app.env.example": b"A="}.items():
        file = tmp_path / name
        file.parent.mkdir(exist_ok=True, parents=True)
        file.write_bytes(data)
    got = {r.path: r.content for r in scan_tree(spark, str(tmp_path), "p").collect()}
    assert got == {"tracked.ts": "const a = 1;", "sub/new.md": "# x", "app.env.example": "A="}


def test_registry(tmp_path):
    r = Registry(tmp_path / "projects.json")
    r.add("one", str(tmp_path))
    with pytest.raises(ValueError):
        r.add("Two", str(tmp_path))
    with pytest.raises(ValueError):
        r.add("two", str(tmp_path))
    assert list(r.entries()) == ["one"]
    r.remove("one")
    assert r.entries() == {}


def test_store_keeps_the_old_generation(spark, tmp_path):
    store = GenerationStore(spark, str(tmp_path / "s"))
    df = spark.createDataFrame([chunk(1, "p", "a.ts", 1, "a")], CHUNKS)
    with pytest.raises(LookupError):
        store.read("chunks")
    store.publish("g1", {"chunks": df})

    def refuse(_):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        store.publish("g2", {"chunks": df.limit(0)}, refuse)
    assert store.published() == "g1" and store.read("chunks").count() == 1
    store.publish("g3", {"chunks": df.limit(0)})
    assert store.published() == "g3" and store.read("chunks").count() == 0


def test_refresh_stream(spark, tmp_path):
    store, source = GenerationStore(spark, str(tmp_path / "s")), str(tmp_path / "in")
    spark.createDataFrame([chunk(1, "p", "a.ts", 1, "a"), chunk(2, "p", "b.ts", 1, "b")], CHUNKS).write.parquet(source)
    refresh_stream(spark.readStream.schema(CHUNKS).parquet(source), store, str(tmp_path / "c")).awaitTermination()
    spark.createDataFrame([chunk(8, "p", "a.ts", 1, "a"), chunk(9, "p", "a.ts", 2, "new")], CHUNKS).write.mode("append").parquet(source)
    refresh_stream(spark.readStream.schema(CHUNKS).parquet(source), store, str(tmp_path / "c")).awaitTermination()
    assert {(r.id, r.path) for r in store.read("chunks").collect()} == {(1, "a.ts"), (2, "b.ts"), (9, "a.ts")}
    assert merge_chunks(None, store.read("chunks")).count() == 3
