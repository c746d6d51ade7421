"""Text functions: folding, tokens, query terms, intents."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_-]+"

# What a query's words are read as, and what they leave out.
STOP_WORDS = (
    "a", "al", "and", "como", "con", "cual", "de", "del", "donde", "el", "en", "es", "esta", "este", "for", "how", "la", "las", "lo", "los", "of", "o", "para", "por", "que", "se", "the", "to", "un",
    "una", "y",
)
NOISE_WORDS = (
    "adjacent", "applicable", "best-located", "complete", "especially", "existing", "including", "relevant", "trace", "versus", "where", "encuentra", "identifica", "incluye", "investiga", "revisa",
)
EXPANSIONS = {
    "ausencia": ("absence", "absences"),
    "ausencias": ("absence", "absences"),
    "empleado": ("employee", "staff"),
    "empleados": ("employee", "employees", "staff"),
    "evaluacion": ("evaluation", "evaluations"),
    "flujo": ("flow", "workflow"),
    "huesped": ("guest",),
    "proyecto": ("project",),
    "reserva": ("reservation", "booking"),
    "saldo": ("balance",),
    "turno": ("shift",),
    "vacaciones": ("vacation", "urlaub", "absence"),
}
#: intent: (what triggers it, the terms it stands for), in order.
INTENTS = {
    "reliability": (("fallo", "falla", "failed", "failure", "timeout", "conexion", "connection", "respuesta", "response"), ("retry", "reconcile", "idempotency", "idempotent", "command", "outbox", "dead_letter", "last_attempt", "error")),
    "duplicate": (("duplic", "repet", "twice", "again", "otra vez", "reint"), ("unique", "idempotency", "existing", "conflict", "lock", "claim", "compare", "reservation")),
    "external_write": (("proveedor", "provider", "extern", "third-party", "remote", "upstream", "webhook", "ack"), ("external", "command", "sync", "ack", "booking", "projection", "reconcile", "worker")),
    "database_guarantee": (("garantia", "garant", "constraint", "restric", "race", "carrera", "concurrent"), ("unique", "transaction", "advisory", "lock", "conflict", "migration", "index")),
    "tests": (("test", "prueba", "spec", "coverage", "cobertura"), ("test", "spec", "assert", "fixture", "mock")),
}
MOST_TERMS = 48


def _fold_table() -> tuple[str, str]:
    """Letters whose canonical form is a plain letter and marks, and those plain letters, by rule over the Latin and Cyrillic blocks."""
    source, target = [], []
    for point in (*range(0xC0, 0x250), *range(0x400, 0x460), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(point))
        if len(parts) > 1 and all(unicodedata.combining(c) for c in parts[1:]):
            source.append(chr(point))
            target.append(parts[0])
    return "".join(source), "".join(target)


_SOURCE, _TARGET = _fold_table()


def folded(column: Column | str) -> Column:
    """Lower case without diacritics, in the JVM; null stays null."""
    low = F.lower(F.col(column) if isinstance(column, str) else column)
    # Translating costs a look-up per character, so plain ASCII, which is most code, goes without.
    return F.when(low.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(low, _SOURCE, _TARGET), r"\p{Mn}", "")).otherwise(low)


def tokens(column: Column | str) -> Column:
    """The tokens of a text: runs of letters, digits, _ and - of the folded text."""
    return F.regexp_extract_all(folded(column), F.lit(TOKEN), F.lit(0))


def fold_text(text: str) -> str:
    """Compatibility fold of a question to ASCII, on the driver."""
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()


def active_intents(question: str) -> list[str]:
    low = fold_text(question)
    return [name for name, (triggers, _) in INTENTS.items() if any(t in low for t in triggers)]


def query_terms(question: str, limit: int = MOST_TERMS) -> list[str]:
    """Search terms of a question: its words with expansions, then its intents' terms; of too many, the first and last halves."""
    out: list[str] = []
    for word in re.findall(r"\w[\w.-]*", fold_text(question)):
        word = word.strip(".-")
        if len(word) > 1 and word not in STOP_WORDS and word not in NOISE_WORDS:
            out += [word, *EXPANSIONS.get(word, ())]
    for name in active_intents(question):
        out += INTENTS[name][1]
    out = list(dict.fromkeys(out))
    return out if len(out) <= limit else out[: limit // 2] + out[-(limit - limit // 2) :]


def occurrences(text: Column, term: str) -> Column:
    """How often a plain term occurs in a text."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


def capped_frequency(text: Column, terms: list[str], cap: int = 4, lowered: bool = False) -> Column:
    """The sum over the terms of their occurrences in the lower-cased text, each counted ``cap`` times at most.

    The text is lower-cased once: it comes along in an array of one, since an expression in a lambda is evaluated at each use.
    """

    def total(low: Column) -> Column:
        out = F.lit(0)
        for term in terms:
            out = out + F.least(F.lit(cap), occurrences(low, term))
        return out

    return total(text) if lowered else F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), total)[0]
