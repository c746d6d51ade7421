"""Comments and literals of source text, with the lexer's state at either end, so that blocks of a file can be read apart.

``lex`` maps (text, state at its start) to (spans, state at its end). Applied to each block of a file under every state that it
may begin in, the results are maps from state to state; composing them is associative, so the blocks of a long file can be
read in any order, in different tasks, and the chain that begins in plain code picks the reading that holds.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODE = "code"

#: Language by ending.
ENDINGS = {"ts": "js", "tsx": "js", "js": "js", "mjs": "js", "jsx": "js", "cjs": "js", "py": "py", "sql": "sql", "go": "go", "sh": "sh"}

_STRINGS = r"\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'"
_MASTER = {
    "js": re.compile(
        r"(?P<comment>//[^\n]*(?:\n[ \t]*//[^\n]*)*|/\*[\s\S]*?(?:\*/|\Z))|(?P<string>" + _STRINGS + r"|`(?:[^`\\]|\\[\s\S])*(?:`|\Z))|"
        r"(?P<regex>(?:(?<=[=(,:\[!&|?{};+])|(?<=return)|(?<=^))[ \t]*/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*)",
        re.M,
    ),
    "go": re.compile(r"(?P<comment>//[^\n]*(?:\n[ \t]*//[^\n]*)*|/\*[\s\S]*?(?:\*/|\Z))|(?P<string>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)+'|`[^`]*(?:`|\Z))"),
    "py": re.compile(r"(?P<comment>#[^\n]*(?:\n[ \t]*#[^\n]*)*)|(?P<string>\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*(?:\"\"\"|\Z)|'''(?:[^'\\]|\\[\s\S]|'(?!''))*(?:'''|\Z)|" + _STRINGS + ")"),
    "sql": re.compile(r"(?P<comment>--[^\n]*(?:\n[ \t]*--[^\n]*)*|/\*[\s\S]*?(?:\*/|\Z))|(?P<string>'(?:[^']|'')*(?:'|\Z)|\"[^\"\n]*\")"),
    "sh": re.compile(r"(?P<comment>(?:(?<=\s)|(?<=^)|(?<=;))#[^\n]*(?:\n[ \t]*#[^\n]*)*)|(?P<string>\"(?:[^\"\\]|\\[\s\S])*(?:\"|\Z)|'[^']*(?:'|\Z)|\\.|\$'(?:[^'\\]|\\.)*')", re.M),
}
# What ends a construct that spans lines, by its state.
_CLOSERS = {
    "/*": re.compile(r"\*/"),
    "`": re.compile(r"(?:[^`\\]|\\[\s\S])*?`"),
    '"""': re.compile(r'(?:[^"\\]|\\[\s\S]|"(?!""))*"""'),
    "'''": re.compile(r"(?:[^'\\]|\\[\s\S]|'(?!''))*'''"),
    "'": re.compile(r"(?:[^']|'')*?'(?!')"),
    '"': re.compile(r'(?:[^"\\]|\\[\s\S])*?"'),
}
#: States that a block of a language may begin in.
STATES = {"js": (CODE, "/*", "`"), "go": (CODE, "/*", "`"), "py": (CODE, '"""', "'''"), "sql": (CODE, "/*", "'"), "sh": (CODE, "'", '"')}


# How files of a language begin their lines.
_SIGNS = {
    "js": re.compile(r"^(?:import\s+[\w{*][^\n]*from\s+[\"']|export\s+(?:default|const|async|function|class|interface|type|abstract|enum)\b|(?:const|let|var)\s+[\w{\[][^\n]*=|(?:async\s+)?function\s+\w+\s*\()", re.M),
    "py": re.compile(r"^(?:from\s+[\w.]+\s+import\s|import\s+\w+(?:\.\w+)*[ \t]*$|def\s+\w+\(|class\s+\w+[^\n;{]*:[ \t]*$)", re.M),
    "go": re.compile(r"^(?:package\s+\w+[ \t]*$|func\s+(?:\(\w+\s+\S+\)\s*)?\w+\()", re.M),
    "sql": re.compile(r"^(?:create\s+(?:or\s+replace|unique|table|index|view|policy|function|type|role)|insert\s+into|alter\s+(?:table|role|user)|update\s+\w+\s+set)\b", re.M | re.I),
    "sh": re.compile(r"^(?:#![^\n]*\b(?:ba|da|z)?sh\b|set -[a-z]+o? )", re.M),
}


def language_of(path: str, text: str) -> str | None:
    """The language of a text by its file's ending, unless it bears no sign of that one and signs of another: a wrong ending."""
    named = language(path)
    if named is None or _SIGNS[named].search(text):
        return named
    found = {lang: len(sign.findall(text)) for lang, sign in _SIGNS.items() if lang != named}
    best = max(found, key=lambda lang: (found[lang], lang))
    return best if found[best] else named


def language(path: str) -> str | None:
    return ENDINGS.get(path.rsplit(".", 1)[-1].lower()) if "." in path else None


def lex(text: str, lang: str, state: str = CODE) -> tuple[list[tuple[str, int, int]], str]:
    """Spans (kind, start, end) of comments, strings and regular expressions, and the state at the end."""
    spans: list[tuple[str, int, int]] = []
    at = 0
    if state != CODE:
        kind = "comment" if state == "/*" else "string"
        m = _CLOSERS[state].search(text) if state == "/*" else _CLOSERS[state].match(text)
        if not m:
            return [(kind, 0, len(text))], state
        spans.append((kind, 0, m.end()))
        at = m.end()
    for m in _MASTER[lang].finditer(text, at):
        spans.append((m.lastgroup, m.start(), m.end()))
    if spans and spans[-1][2] == len(text):
        kind, start, end = spans[-1]
        last = text[start:]
        for opener in STATES[lang][1:]:
            if last.startswith(opener) and not (len(last) > len(opener) and last.endswith("*/" if opener == "/*" else opener) and last != opener):
                return spans, opener
    return spans, CODE


def entry_states(maps: DataFrame) -> DataFrame:
    """project, path, block, state: the state in which each block after the first begins.

    maps: project, path, block, state, leads_to: the map of each block, a row per state. Only files of several blocks come here;
    a file's maps are composed in order of its blocks, a few short strings each.
    """
    ordered = maps.groupBy("project", "path", "block").agg(F.array_sort(F.collect_list(F.struct("state", "leads_to"))).alias("map"))
    files = ordered.groupBy("project", "path").agg(F.array_sort(F.collect_list(F.struct("block", "map"))).alias("blocks"))

    def compose(so_far: Column, one: Column) -> Column:
        states = so_far["states"]
        now = F.coalesce(F.try_element_at(F.map_from_entries(one["map"]), F.element_at(states, -1)), F.lit(CODE))
        return F.struct(F.concat(states, F.array(now)).alias("states"))

    begun = F.aggregate("blocks", F.struct(F.array(F.lit(CODE)).alias("states")), compose)["states"]
    pairs = F.transform("blocks", lambda b, i: F.struct(b["block"].alias("block"), F.element_at(begun, i + 1).alias("state")))
    return files.select("project", "path", F.explode(pairs).alias("p")).select("project", "path", "p.*").where("block > 0")
