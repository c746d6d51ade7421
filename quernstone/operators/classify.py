"""Classes of source files by path, and path predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SEARCHABLE = ("code", "test", "schema_history", "generated", "config")
WEIGHTS = {"test": 1.60, "code": 1.50, "schema_history": 1.35, "canonical": 1.10, "config": 0.80, "generated": 0.70, "active": 0.55, "historical": 0.30}
UNKNOWN_WEIGHT = 1.0
EXTENSIONS = (
    ".bash", ".c", ".cc", ".cjs", ".conf", ".cpp", ".cs", ".css", ".csv", ".cts", ".dart", ".env.example", ".ex", ".exs", ".fs", ".fsx", ".go", ".gradle", ".graphql", ".groovy", ".h", ".html", ".java",
    ".js", ".json", ".jsx", ".kt", ".kts", ".lua", ".md", ".mjs", ".mts", ".php", ".pl", ".proto", ".py", ".rb", ".rs", ".rst", ".scala", ".scss", ".sh", ".sql", ".svelte", ".swift", ".toml", ".ts",
    ".tsx", ".txt", ".vue", ".xml", ".yaml", ".yml", ".zsh",
)
SKIP_NAMES = ("package-lock.json", "bun.lock", "bun.lockb", "deno.lock")
SKIP_FOLDERS = ("node_modules", "dist", "build", "coverage", ".git")
MOST_BYTES = 1_500_000
SECRET = r"(?i)(^|/)(\.env($|\.)|.*\.(pem|key|p12|pfx)$)"
CONFIG_NAMES = ("package.json", "pyproject.toml", "cargo.toml", "go.mod", "pom.xml", "build.gradle", "build.gradle.kts", "makefile")


def _rules(path: Column) -> list[tuple[str, str, Column]]:
    """(reason, authority, condition), in order: the first that holds decides."""
    low = F.lower(path)
    parts = F.split(low, "/")
    name = F.element_at(parts, -1)
    folders = F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - 1))
    return [
        ("history folder", "historical", low.contains("/history/") | low.startswith("docs/history/")),
        ("generated types", "generated", low.endswith("src/integrations/supabase/types.ts")),
        ("migration", "schema_history", low.startswith("migrations/") | low.contains("/migrations/")),
        ("instructions", "canonical", low.endswith("agents.md")),
        ("reference documents", "canonical", low.startswith("docs/architecture/") | low.startswith("docs/reference/")),
        ("documents", "active", low.startswith("docs/")),
        ("configuration", "config", name.isin(*CONFIG_NAMES) | name.rlike(r"^(tsconfig|jest\.config|vitest\.config|vite\.config)")),
        ("project document", "active", name.isin("readme.md", "contributing.md", "code_of_conduct.md")),
        ("change log", "historical", name.isin("changelog.md", "history.md", "changes.md")),
        ("text or workflow", "active", name.rlike(r"\.(md|rst)$") | low.startswith(".github/")),
        ("test", "test", F.arrays_overlap(folders, F.array(*map(F.lit, ("test", "tests", "spec", "specs", "__tests__")))) | name.rlike(r"\.test\.|\.spec\.|_test\.|_spec\.")),
        ("source", "code", F.lit(True)),
    ]


def _first(path: Column, what: int) -> Column:
    out = F.when(path.isNull(), F.lit(None).cast("string"))
    for rule in _rules(path):
        out = out.when(rule[2], rule[what])
    return out


def authority_of(path: Column) -> Column:
    """The authority class of a path: the first rule that matches decides; null for a null path."""
    return _first(path, 1)


def reason_of(path: Column) -> Column:
    """The rule that decided on a path's authority; null for a null path."""
    return _first(path, 0)


def is_searchable(authority: Column) -> Column:
    return F.coalesce(authority.isin(*SEARCHABLE), F.lit(False))


def weight_of(authority: Column) -> Column:
    out = F.lit(UNKNOWN_WEIGHT)
    for name, weight in WEIGHTS.items():
        out = F.when(authority == name, weight).otherwise(out)
    return out


def is_secret_path(path: Column) -> Column:
    return path.rlike(SECRET)


def is_safe_path(path: Column) -> Column:
    """Relative, not empty, and without a step upwards."""
    return F.coalesce((F.length(path) > 0) & ~path.startswith("/") & ~path.rlike(r"(^|/)\.\.(/|$)"), F.lit(False))


def is_indexable_path(path: Column) -> Column:
    """Known ending, no secret, no skipped name or folder."""
    low = F.lower(path)
    parts = F.split(low, "/")
    ending = F.lit(False)
    for e in EXTENSIONS:
        ending = ending | low.endswith(e)
    return ending & ~is_secret_path(path) & ~F.element_at(parts, -1).isin(*SKIP_NAMES) & ~F.arrays_overlap(parts, F.array(*map(F.lit, SKIP_FOLDERS)))
