"""Symbols and edges out of source text: SQL scripts and TypeScript or JavaScript modules, at the level of patterns."""

from __future__ import annotations

import bisect
import json
import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.operators.classify import authority_of, reason_of
from quernstone.operators.files import WHOLE, each_block, windows_by_block
from quernstone.operators.graph import UNRESOLVED, latest_definitions, resolve_targets
from quernstone.session import cut

# What a definition, a call and a use of a table look like in SQL, and names that are none.
SQL_DEFINITIONS = {
    "function": r"\bcreate\s+(?:or\s+replace\s+)?function\s+([\w.]+)\s*\(",
    "table": r"\bcreate\s+table\s+(?:if\s+not\s+exists\s+)?([\w.]+)",
    "view": r"\bcreate\s+(?:or\s+replace\s+)?(?:materialized\s+)?view\s+([\w.]+)",
    "policy": r"\bcreate\s+policy\s+(\"[^\"]+\"|\w+)\s+on\s+([\w.]+)",
    "trigger": r"\bcreate\s+(?:or\s+replace\s+)?trigger\s+([\w.]+)",
    "type": r"\bcreate\s+type\s+([\w.]+)",
}
SQL_CALL_STOP = (
    "and", "any", "array", "as", "avg", "bool_or", "case", "check", "coalesce", "conflict", "count", "date_trunc", "exists", "extract", "filter", "from", "greatest", "if", "in", "json_agg", "json_build_object",
    "jsonb_agg", "jsonb_build_object", "key", "lateral", "least", "make_interval", "max", "min", "nullif", "numeric", "or", "over", "return", "round", "select", "sum", "table", "unique", "using", "values", "when", "where",
)
SQL_TABLE_STOP = ("anon", "lateral", "of", "on", "or", "public", "set", "to", "using")
_SQL_DEFS = {kind: re.compile(p, re.I) for kind, p in SQL_DEFINITIONS.items()}
_SQL_CALL = re.compile(r"\b(public\.)?([a-z_]\w*)\s*\(", re.I)
_SQL_TABLE = re.compile(r"\b(from|join|update|into|delete\s+from)\s+([\w.]+)", re.I)
_DOLLAR = re.compile(r"\$(\w*)\$")
# Comments and strings of scripts; their insides are blanked out before structure is looked for.
_QUIET = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S)
_DECLARED = re.compile(
    r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:(?:async\s+)?function\s*\*?\s*(?P<function>[\w$]+)|class\s+(?P<class>[\w$]+)(?:\s*<[^{\n]*?>)?(?:\s+extends\s+(?P<base>[\w$.]+))?|"
    r"interface\s+(?P<interface>[\w$]+)|type\s+(?P<type>[\w$]+)\s*(?:<[^=\n]*>)?=|(?:const\s+)?enum\s+(?P<enum>[\w$]+)|(?:const|let|var)\s+(?P<variable>[\w$]+)[^=\n;]*=\s*(?:async\s*)?(?:function\b|(?:<[^=\n]*>)?(?:\([^()]*\)|[\w$]+)[^=\n;{]*=>))",
    re.M,
)
_EXPRESSION = re.compile(r"(?<![\w$.])function\s*\*?\s+([\w$]+)\s*\(")
_MEMBER = re.compile(r"^[ \t]+(?:(?:public|private|protected|static|async|get|set|override|readonly|abstract)\s+)*\*?\s*(?P<name>[#\w$]+)\s*(?:<[^()\n]*>)?\([^()]*(?:\([^()]*\)[^()]*)*\)[^;{}\n=]*\{", re.M)
_IMPORT = re.compile(r"^[ \t]*import\s+(?:type\s+)?(?:(?P<what>[^'\"\n;()]*?(?:\{[^}]*\}[^'\"\n;()]*?)?)\s*from\s*)?(?P<quote>['\"])", re.M)
_CALL = re.compile(r"(?<![\w$.#])(?P<chain>[A-Za-z_$][\w$]*(?:\s*(?:\?\.|\.)\s*#?[\w$]+)*)\s*(?P<optional>\?\.)?\s*\(")
_NO_CALL = frozenset(("if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "super", "constructor", "import", "new", "throw", "of", "in", "do", "else", "void", "delete", "yield", "case", "async", "require"))
_WRITES = re.compile(r"\.(insert|update|upsert|delete)\(")
_CHAIN = re.compile(r"(?:\s*\??\.\s*[\w$]+\s*\([^()]*(?:\([^()]*\)[^()]*)*\))*")
_BRACE, _BRACKET = re.compile(r"[{}]"), re.compile(r"[()\[\]{},]")
ENDINGS = ("", ".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")
FUNCTIONS = ("function", "hook", "component", "method")
SIGNATURE, EXPRESSION = 500, 240

SYMBOLS = "project string, path string, kind string, name string, qualified_name string, start_line int, end_line int, signature string, metadata string"
EDGES = "project string, source_path string, source_name string, source_qualified_name string, relation string, target_name string, target_qualified_name string, via string, line int, metadata string, resolution_confidence string"


def _line_starts(text: str) -> list[int]:
    return [0, *[m.end() for m in re.finditer("\n", text)]]


def _json(**fields) -> str:
    return json.dumps(fields, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def definition_end(text: str, start: int) -> int:
    """Where an SQL definition ends: behind its dollar-quoted body and semicolon, or at the next semicolon, or at the text's end."""
    semicolon = text.find(";", start)
    m = _DOLLAR.search(text, start)
    if m and (semicolon < 0 or m.start() < semicolon):
        close = text.find(m.group(), m.end())
        if close >= 0:
            semicolon = text.find(";", close + len(m.group()))
            return semicolon + 1 if semicolon >= 0 else close + len(m.group())
    return semicolon + 1 if semicolon >= 0 else len(text)


class Spans:
    """Nested stretches (start, end, value) of a text, asked for those that hold an offset."""

    def __init__(self, spans: list[tuple]):
        self.spans = sorted(spans, key=lambda s: (s[0], -s[1]))
        self.begins = [s[0] for s in self.spans]
        self.around, is_open = [], []  # of each stretch the one around it
        for k, (start, _, _) in enumerate(self.spans):
            while is_open and self.spans[is_open[-1]][1] <= start:
                is_open.pop()
            self.around.append(is_open[-1] if is_open else -1)
            is_open.append(k)

    def holding(self, offset: int) -> list[tuple]:
        """Those that hold the offset, innermost first."""
        out, k = [], bisect.bisect_right(self.begins, offset) - 1
        while k >= 0:
            if offset < self.spans[k][1]:
                out.append(self.spans[k])
            k = self.around[k]
        return out


def extract_sql(text: str) -> tuple[list[tuple], list[tuple]]:
    """Symbols (kind, name, qualified name, first line, last line, signature, metadata) and edges (source, qualified source, relation,
    target, qualified target, via, line, metadata, confidence) of a script. Names stay as they are written, with their schema."""
    starts = _line_starts(text)
    line = lambda offset: bisect.bisect_right(starts, offset)
    symbols, spans, defined = [], [], set()
    for kind, pattern in _SQL_DEFS.items():
        for m in pattern.finditer(text):
            name, end = m.group(1).strip('"'), definition_end(text, m.start())
            symbols.append((kind, name, name, line(m.start()), line(max(m.start(), end - 1)), m.group()[:SIGNATURE], _json(table=m.group(2)) if kind == "policy" else "{}"))
            spans.append((m.start(), end, name))
            defined.add(m.start(1))
    owners, edges = Spans(spans), []

    def add(offset: int, relation: str, target: str, metadata: str) -> None:
        owner = next((s[2] for s in owners.holding(offset)), "<script>")
        edges.append((owner, owner, relation, target, target, "", line(offset), metadata, "lexical"))

    for m in _SQL_CALL.finditer(text):
        if m.group(2).lower() not in SQL_CALL_STOP and m.start() not in defined and m.start(2) not in defined and "function" not in text[max(0, m.start() - 40) : m.start()].lower():
            add(m.start(), "calls_sql", (m.group(1) or "") + m.group(2), "{}")
    for m in _SQL_TABLE.finditer(text):
        operation = re.sub(r"\s+", " ", m.group(1).lower())
        if m.group(2).lower() not in SQL_TABLE_STOP and not (operation == "from" and "extract" in text[max(0, m.start() - 30) : m.start()].lower()):
            add(m.start(), "accesses_table", m.group(2), _json(operation=operation))
    return symbols, edges


def _block_end(text: str, offset: int) -> int:
    """The end of the braces that open at or behind an offset, or of the line if none do."""
    stop = text.find("\n", offset)
    open_at = text.find("{", offset)
    if open_at < 0 or (0 <= stop < open_at and text.count("\n", offset, open_at) > 8):
        return stop if stop >= 0 else len(text)
    depth = 0
    for m in _BRACE.finditer(text, open_at):
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return m.end()
    return len(text)


def _blank(m: re.Match) -> str:
    text = m.group()
    inside = re.sub(r"[^\n]", " ", text)
    return text[0] + inside[1:-1] + text[-1] if text[0] in "\"'`" and len(text) > 1 else inside


def _arguments(masked: str, open_at: int) -> int:
    """How many arguments the brackets that open at an offset hold."""
    depth, commas, last = 0, 0, open_at
    for m in _BRACKET.finditer(masked, open_at):
        c = m.group()
        if c == ",":
            if depth == 1:
                commas += 1
                last = m.start()
        else:
            depth += 1 if c in "([{" else -1
            if depth == 0:
                trailing = not masked[last + 1 : m.start()].strip()
                return commas + (0 if trailing else 1)
    return commas + 1


def _literal(text: str, masked: str, open_at: int) -> str:
    """The first argument if it is a plain string."""
    m = re.compile(r"\(\s*(['\"`])").match(masked, open_at)
    if not m:
        return ""
    end = masked.find(m.group(1), m.end())
    value = text[m.end() : end] if end >= 0 else ""
    return "" if "${" in value else value


def _bindings(masked: str, text: str, line) -> tuple[dict[str, tuple[str, str, bool]], list[tuple[str, int]]]:
    """(local name: (imported name, specifier, whether a namespace); (specifier, line) of each import)."""
    bound: dict[str, tuple[str, str, bool]] = {}
    imports = []
    for m in _IMPORT.finditer(masked):
        end = masked.find(m["quote"], m.end())
        if end < 0:
            continue
        specifier, what = text[m.end() : end], m["what"] or ""
        imports.append((specifier, line(m.start())))
        braces = re.search(r"\{([^}]*)\}", what)
        for part in (braces.group(1) if braces else "").split(","):
            words = part.replace("type ", " ").split()
            if words:
                bound[words[-1]] = (words[0], specifier, False)
        rest = re.sub(r"\{[^}]*\}", "", what)
        if star := re.search(r"\*\s*as\s+([\w$]+)", rest):
            bound[star.group(1)] = ("*", specifier, True)
            rest = rest.replace(star.group(), "")
        if name := rest.strip(" ,\n\t"):
            bound[name] = ("default", specifier, False)
    return bound, imports


def extract_script(text: str, path: str = "") -> tuple[list[tuple], list[tuple]]:
    """As extract_sql, of a TypeScript or JavaScript module. via: the import that a target comes through, '.' for the file itself."""
    masked = _QUIET.sub(_blank, text)
    starts = _line_starts(text)
    line = lambda offset: bisect.bisect_right(starts, offset)
    found: list[tuple[int, int, str, str]] = []  # start, end, kind, name
    bases: dict[tuple[int, int], str] = {}
    names_at: set[int] = set()
    for m in _DECLARED.finditer(masked):
        kind = next(k for k in ("function", "class", "interface", "type", "enum", "variable") if m[k])
        name = m[kind]
        begin = m.start() + len(m.group()) - len(m.group().lstrip())
        end = _block_end(masked, m.end() - (1 if kind == "variable" else 0))
        names_at.add(m.start(kind))
        if kind == "variable":
            kind = "hook" if name.startswith("use") else "component" if name[0].isupper() else "function"
        if kind == "class" and m["base"]:
            bases[begin, end] = m["base"]
        found.append((begin, end, kind, name))
    for m in _EXPRESSION.finditer(masked):
        if m.start(1) not in names_at:
            names_at.add(m.start(1))
            found.append((m.start(), _block_end(masked, m.end()), "function", m.group(1)))
    classes = Spans([(s, e, n) for s, e, k, n in found if k == "class"])
    for start, end, _, name in [f for f in found if f[2] == "class"]:
        for m in _MEMBER.finditer(masked, masked.find("{", start) + 1, end):
            inner = classes.holding(m.start("name"))
            if inner and inner[0][:2] == (start, end) and (m["name"] not in _NO_CALL or m["name"] == "constructor") and m.start("name") not in names_at:
                names_at.add(m.start("name"))
                found.append((m.start("name"), _block_end(masked, m.end() - 1), "method", m["name"]))
    members: dict[tuple[int, int], list[tuple[int, str]]] = {}
    for s, _, k, n in sorted(found):
        if k == "method" and n != "constructor" and (inner := classes.holding(s)):
            members.setdefault(inner[0][:2], []).append((s, n))
    class_names = {(s, e): n for s, e, k, n in found if k == "class"}
    functions = Spans([(s, e, (n, k)) for s, e, k, n in found if k in FUNCTIONS])

    def qualified(start: int, name: str) -> str:
        parts = [s[2] for s in reversed(classes.holding(start)) if s[0] < start]
        for s in functions.holding(start):
            if s[0] < start and s[2][0] != name and s[2][0] not in parts:
                parts.insert(0, s[2][0])
        return ".".join([*parts, name])

    stem = posixpath.splitext(posixpath.basename(path))[0] or "<module>"
    symbols: list[tuple] = [("module", stem, path or "<module>", 1, len(starts), path, "{}")]
    local: dict[str, list[tuple[str, str]]] = {}
    full: dict[tuple[int, int], str] = {}
    for start, end, kind, name in sorted(found):
        q = full[start, end] = qualified(start, name)
        symbols.append((kind, name, q, line(start), line(max(start, end - 1)), text[start:end].split("{", 1)[0].strip()[:SIGNATURE], "{}"))
        local.setdefault(name, []).append((kind, q))
    module = ("<module>", path or "<module>")
    bound, imports = _bindings(masked, text, line)
    edges: list[tuple] = [(*module, "imports", specifier, None, specifier, at, "{}", "external_or_unresolved") for specifier, at in imports]

    def owner(offset: int) -> tuple[str, str]:
        held = functions.holding(offset)
        return (held[0][2][0], full[held[0][0], held[0][1]]) if held else module

    for (start, end), base in bases.items():
        name = class_names[start, end]
        root, last = base.split(".")[0], base.split(".")[-1]
        own = full[start, end]
        if root in bound:
            imported, via, namespace = bound[root]
            target, confidence = last if namespace or imported == "default" else imported, "import_resolved_inheritance"
        elif any(k == "class" for k, _ in local.get(last, [])):
            target, via, confidence = next(q for k, q in local[last] if k == "class"), ".", "same_file_inheritance"
        else:
            continue
        edges.append((name, own, "extends", last, target, via, line(start), _json(subclass=own), confidence))
        for s, n in members.get((start, end), ()):
            edges.append((n, f"{own}.{n}", "overrides", n, f"{target}.{n}", via, line(s), _json(base_class=last, subclass=own), confidence))
    for m in _CALL.finditer(masked):
        chain = re.sub(r"\s+", "", m["chain"])
        parts = chain.replace("?.", ".").split(".")
        root, last = parts[0], parts[-1]
        before = masked[max(0, m.start() - 12) : m.start()].rstrip()
        if root in _NO_CALL or before.endswith("function") or before.endswith("new") and not before[:-3].endswith("_") or m.start() + len(m["chain"]) - len(last) in names_at or len(parts) == 1 and m.start() in names_at:
            continue
        open_at, at = m.end() - 1, line(m.start())
        source = owner(m.start())
        if len(parts) > 1 and last == "rpc":
            if name := _literal(text, masked, open_at):
                edges.append((*source, "calls_rpc", f"public.{name}", f"public.{name}", "", at, "{}", "literal"))
        elif len(parts) > 1 and last == "from":
            if name := _literal(text, masked, open_at):
                close = _closing(masked, open_at)
                writes = bool(_WRITES.search(re.sub(r"\s+", "", _CHAIN.match(masked, close).group())))
                edges.append((*source, "writes_table" if writes else "reads_table", f"public.{name}", f"public.{name}", "", at, _json(operation="write" if writes else "read"), "literal"))
        elif parts[-2:] == ["functions", "invoke"]:
            if name := _literal(text, masked, open_at):
                edges.append((*source, "invokes_edge_function", name, name, "", at, "{}", "literal"))
        else:
            target, via, confidence = last, "", UNRESOLVED
            candidates = local.get(last, []) if len(parts) == 1 or root == "this" else []
            around = [s[2] for s in classes.holding(m.start())]
            same = next((q for _, q in candidates if any(q.startswith(f"{c}.") for c in around)), None) or (candidates[0][1] if len(candidates) == 1 else None)
            if root in bound:
                imported, via, namespace = bound[root]
                target, confidence = last if namespace or len(parts) > 1 else imported, "import_resolved"
            elif same:
                target, via, confidence = same, ".", "same_file"
            elif root == "this":
                via, confidence = ".", "same_class_unresolved"
            metadata = _json(expression=chain[:EXPRESSION], receiver=root, argument_count=_arguments(masked, open_at), optional_chain=bool(m["optional"]), call_kind="identifier" if len(parts) == 1 else "property")
            edges.append((*source, "calls", last, target, via, at, metadata, confidence))
    return symbols, edges


def _closing(masked: str, open_at: int) -> int:
    depth = 0
    for m in _BRACKET.finditer(masked, open_at):
        depth += 1 if m.group() in "([{" else -1 if m.group() != "," else 0
        if depth == 0:
            return m.end()
    return len(masked)


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over files: a row per file with its symbols and its edges."""

    def kind(schema: str) -> pa.DataType:
        return pa.list_(pa.struct([(name, pa.int32() if sort == "int" else pa.string()) for name, sort in (f.split() for f in schema.split(", ")[2:])]))

    names = [[f.split()[0] for f in schema.split(", ")[2:]] for schema in (SYMBOLS, EDGES)]
    for blocks in each_block(batches, WHOLE):
        rows = [(project, path, *[[dict(zip(names[k], row, strict=True)) for row in part] for k, part in enumerate(extract_sql(text) if path.lower().endswith(".sql") else extract_script(text, path))]) for project, path, _, _, text in blocks]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], kind(SYMBOLS)), pa.array([r[3] for r in rows], kind(EDGES))], names=["project", "path", "symbols", "edges"])


def extract_files(chunks: DataFrame) -> DataFrame:
    """project, path, symbols, edges: what each SQL, TypeScript and JavaScript file of chunks holds, as arrays; others hold nothing.

    Owners, bindings and local names hold for a whole file, so its text comes in one piece; a task holds a file at a time. Lines count
    from 1 in the file. Null contents hold nothing.
    """
    sources = windows_by_block(chunks.where(F.col("path").rlike(r"(?i)\.(sql|tsx?|mts|cts|jsx?|mjs|cjs)$")), WHOLE)
    array = lambda schema: "array<struct<" + ", ".join(": ".join(f.split()) for f in schema.split(", ")[2:]) + ">>"
    return sources.mapInArrow(_both, f"project string, path string, symbols {array(SYMBOLS)}, edges {array(EDGES)}")


def extract_symbols(chunks: DataFrame) -> DataFrame:
    """Symbols of all files of chunks; nameless ones are left out."""
    return symbols_of(extract_files(chunks))


def extract_edges(chunks: DataFrame) -> DataFrame:
    """Edges out of all files of chunks, before targets are resolved; those without a target are left out."""
    return edges_of(extract_files(chunks))


def symbols_of(files: DataFrame) -> DataFrame:
    return files.select("project", "path", F.explode("symbols").alias("s")).select("project", "path", "s.*").where("name <> ''")


def edges_of(files: DataFrame) -> DataFrame:
    return files.select("project", F.col("path").alias("source_path"), F.explode("edges").alias("e")).select("project", "source_path", "e.*").where("target_name <> ''")


def import_base(source_path: Column, via: Column) -> Column:
    """The path that an import names, without ending: of one that begins with a dot beside the file, of one with @/ below src; else null.

    Steps up are taken natively: each name that a .. follows goes with it.
    """
    joined = F.concat(F.regexp_replace(source_path, r"[^/]*$", ""), via)
    parts = F.filter(F.split(joined, "/"), lambda p: (p != ".") & (p != ""))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.coalesce(F.element_at(acc, -1), F.lit("")) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.when(via.startswith("@/"), F.concat(F.lit("src/"), F.substring(via, 3, 4096))).when(via.startswith("."), F.array_join(kept, "/"))


def resolve_imports(edges: DataFrame, files: DataFrame) -> DataFrame:
    """project, source_path, via, target_path: imports whose candidates include a file (project, path); the first that exists.

    Candidates are the path with each ending, then index files below it; they meet the files in one equi join.
    """
    wanted = edges.where("via is not null and via not in ('', '.')").select("project", "source_path", "via").distinct()
    based = wanted.withColumn("base", import_base(F.col("source_path"), F.col("via"))).where("base is not null")
    names = F.array(*[F.concat("base", F.lit(e)) for e in ENDINGS], *[F.concat("base", F.lit(f"/index{e}")) for e in ENDINGS[1:]])
    rows = based.select("project", "source_path", "via", F.posexplode(names).alias("at", "path"))
    hits = rows.join(files.select("project", "path").distinct(), ["project", "path"])
    return hits.groupBy("project", "source_path", "via").agg(F.min_by("path", "at").alias("target_path"))


def resolved_edges(edges: DataFrame, files: DataFrame) -> DataFrame:
    """The edges with target_path and the confidence that its resolution gives; inheritance from files that aren't there is left out."""
    found = edges.join(resolve_imports(edges, files), ["project", "source_path", "via"], "left")
    path = F.when(F.col("via") == ".", F.col("source_path")).otherwise(F.col("target_path"))
    confidence = F.when((F.col("relation") == "imports") & path.isNotNull(), "exact_path").when((F.col("resolution_confidence") == "import_resolved") & path.isNull(), "external_import").otherwise(F.col("resolution_confidence"))
    out = found.withColumn("target_path", path).withColumn("resolution_confidence", confidence).drop("via")
    return out.where(~F.col("relation").isin("extends", "overrides") | F.col("target_path").isNotNull())


def build_graph(chunks: DataFrame, generation: Column | None = None) -> dict[str, DataFrame]:
    """source_authority, symbols and edges of one generation out of its chunks: extracted, the latest definitions marked, targets resolved.

    Ids are hashes of what a row says and its number among equal rows. commit_hash and generation_id are the chunks' project's.
    """
    own = chunks.groupBy("project").agg(F.max("commit_hash").alias("commit_hash"), F.max("generation_id" if generation is None else generation).alias("generation_id"))
    files = chunks.select("project", "path").distinct()
    found = cut(extract_files(chunks))  # read by both
    symbols = symbols_of(found).withColumn("active", F.lit(1))
    symbols = symbols.withColumn("id", F.xxhash64("project", "path", "kind", "qualified_name", "start_line", "end_line", "signature")).dropDuplicates(["id"])
    latest = latest_definitions(symbols.where(F.col("path").rlike(r"(?i)\.sql$")), "").select("id", F.col("active").alias("newest"))
    symbols = symbols.join(latest, "id", "left").withColumn("active", F.coalesce("newest", "active")).drop("newest")
    edges = resolved_edges(edges_of(found), files)
    edges = edges.withColumn("id", F.xxhash64("project", "source_path", "source_qualified_name", "relation", "target_name", "target_qualified_name", "line", "metadata"))
    active = resolve_targets(edges, symbols).where("target_path is not null").select("id", F.col("target_path").alias("sql_path")).dropDuplicates(["id"])
    edges = edges.join(active, "id", "left").withColumn("resolution_confidence", F.when(F.col("sql_path").isNotNull(), "active_sql").otherwise(F.col("resolution_confidence"))).withColumn("target_path", F.coalesce("target_path", "sql_path")).drop("sql_path")
    authority = files.select("project", "path", authority_of(F.col("path")).alias("authority"), reason_of(F.col("path")).alias("reason"))
    return {name: df.join(own, "project") for name, df in {"source_authority": authority, "symbols": symbols, "edges": edges}.items()}


def graph_statistics(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """project, symbols, edges, unresolved, module_owned: how large a graph is and how much of it is open."""
    counted = edges.groupBy("project").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("resolution_confidence") == UNRESOLVED).alias("unresolved"), F.count_if(F.col("source_name") == "<module>").alias("module_owned"))
    return symbols.groupBy("project").agg(F.count(F.lit(1)).alias("symbols")).join(counted, "project", "full_outer").select("project", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("symbols", "edges", "unresolved", "module_owned")])
