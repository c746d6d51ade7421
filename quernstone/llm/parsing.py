"""Source files that are not valid in the language of their ending, and their rates (problem 7).

Blocks of files become lexer-state maps and bracket summaries, which combine associatively, so a file of any length is judged
without being held in one task: a chain of states that doesn't end in code, or a bracket without partner, breaks it. Balanced
statements are then parsed with the language's local grammar: at once where a file is one block, as nearly all are, and else
piece by piece, in order of the blocks, with what is left open carried on to the next block. Of Python and JSON, what the local
grammar refuses is read once more by the language's own parser, so that nothing valid comes out.
"""

from __future__ import annotations

import ast
import json
import re
import sys
import warnings
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.grammar import bracket_summary, join_summaries
from quernstone.llm.grammar_go import Go
from quernstone.llm.grammar_js import Js
from quernstone.llm.grammar_py import Py
from quernstone.llm.grammar_sql import _LEX as _SQL_LEX
from quernstone.llm.grammar_sql import Sql
from quernstone.llm.lexing import CODE, STATES, lex
from quernstone.operators.files import BLOCK_LINES, each_block, windows_by_block

#: Calls that may be open while a text is parsed: enough for some thousand nested brackets.
DEPTH = 20_000
LANGUAGES = {"ts": "ts", "tsx": "tsx", "js": "js", "mjs": "js", "py": "py", "sql": "sql", "go": "go", "json": "json"}
_LEXER = {"ts": "js", "tsx": "js", "js": "js", "py": "py", "sql": "sql", "go": "go"}
_CONFLICT = re.compile(r"^(?:<{7} |>{7} |={7}$)", re.M)


def _constant(_: str) -> None:
    raise ValueError("not a number of JSON")


def _json(text: str) -> bool:
    try:
        json.loads(text, parse_constant=_constant)
    except RecursionError:
        return True
    except ValueError:
        return False
    return True


# Literals of JSON as single signs, and the groups that hold values.
_JSON_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"')
_JSON_VALUE = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null")
_JSON_GROUP = re.compile("\\{(?:\x01:[\x01\x02](?:,\x01:[\x01\x02])*+)?\\}|\\[(?:[\x01\x02](?:,[\x01\x02])*+)?\\]")
_BLANK = dict.fromkeys(map(ord, " \t\r\n"))
#: Rounds of folding; what is nested deeper is read token by token.
_ROUNDS = 200


def folds_to_value(text: str) -> bool:
    """Whether a text is JSON: literals become signs, and every object or array that holds nothing but values a value, inside out."""
    if "\x01" in text or "\x02" in text:
        return False
    shape, n = _JSON_VALUE.sub("\x02", _JSON_STRING.sub("\x01", text)).translate(_BLANK), 1
    for _ in range(_ROUNDS):
        shape, n = _JSON_GROUP.subn("\x02", shape)
        if not n:
            return shape in ("\x01", "\x02")
    stream = JsonStream()
    stream.feed(text)
    return stream.end()


def _python(text: str) -> bool:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(text, "file", "exec", ast.PyCF_ONLY_AST, dont_inherit=True)
    except (RecursionError, MemoryError):
        return True
    except (SyntaxError, ValueError):
        return False
    return True


@lru_cache(maxsize=1)
def _checks() -> dict:
    """The grammars, with what they have seen, of this worker."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), DEPTH))
    return {"ts": Js(True, False).check, "tsx": Js(True, True).check, "js": Js(False, True).check, "go": Go().check, "sql": Sql().check, "json": folds_to_value, "py": Py().check}


# What a language's own parser says of a text that the grammar refuses, where there is one.
_EXACT = {"json": _json, "py": _python}


def is_valid(text: str, lang: str) -> bool:
    """Whether a whole text is valid: lang is a value of LANGUAGES."""
    if lang != "json" and text.startswith("﻿"):
        text = text[1:]
    return _checks()[lang](text) or (lang in _EXACT and _EXACT[lang](text))


def block_map(text: str, lang: str, state: str) -> tuple[str, str, bool]:
    """(state at the end, brackets without partner, whether a conflict mark stands in code) of a block read from a state."""
    if lang == "json":
        plain, leads_to = re.sub(r'"(?:[^"\\\n]|\\.)*"', "", text), CODE
    else:
        spans, leads_to = lex(text, _LEXER[lang], state)
        parts, at = [], 0
        for _, start, end in spans:
            parts.append(text[at:start])
            at = end
        plain = " ".join([*parts, text[at:]])
    return leads_to, bracket_summary(plain), bool(_CONFLICT.search(plain))


def join_block(state: str, summary: str, entries: list[tuple[str, str, str, bool]]) -> tuple[str, str, bool]:
    """(state, summary, conflict) behind a block that follows on a state and a summary; entries: (state, leads_to, summary, conflict)."""
    own = {e[0]: e for e in entries}
    _, leads_to, more, conflict = own.get(state) or own[CODE]
    return leads_to, join_summaries(summary, more), conflict


def join_blocks(blocks: list[tuple[int, list[tuple[str, str, str, bool]]]]) -> bool:
    """Whether a file's blocks, given as (block, [(state, leads_to, summary, conflict)]), hold together."""
    state, summary = CODE, ""
    for _, entries in sorted(blocks):
        state, summary, conflict = join_block(state, summary, entries)
        if conflict:
            return False
    return state == CODE and summary == ""


_JSON_TOKEN = re.compile(r'[ \t\r\n]*(?:(?P<s>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<v>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)|(?P<o>[\[\]{},:]))')


class JsonStream:
    """JSON token by token, across blocks; no token of JSON holds a line's end, so none crosses blocks."""

    def __init__(self) -> None:
        self.open: list[str] = []
        self.wants, self.good = "value", True

    def feed(self, text: str) -> None:
        at, stop = 0, len(text.rstrip(" \t\r\n"))
        while self.good and at < stop:
            m = _JSON_TOKEN.match(text, at)
            self.good = bool(m) and self._step(m.lastgroup, m[m.lastgroup])
            at = m.end() if m else at

    def end(self) -> bool:
        return self.good and self.wants == "nothing"

    def _closed(self) -> bool:
        self.wants = "comma" if self.open else "nothing"
        return True

    def _step(self, kind: str, token: str) -> bool:
        wants = self.wants
        if kind == "s" and wants in ("key", "first key"):
            self.wants = "colon"
            return True
        if wants in ("value", "first value") and (kind != "o" or token in "[{"):
            if kind != "o":
                return self._closed()
            self.open.append(token)
            self.wants = "first value" if token == "[" else "first key"
            return True
        if token == ":" and wants == "colon":
            self.wants = "value"
            return True
        if token == "," and wants == "comma":
            self.wants = "key" if self.open[-1] == "{" else "value"
            return True
        if self.open and (token == "]" and self.open[-1] == "[" and wants in ("first value", "comma") or token == "}" and self.open[-1] == "{" and wants in ("first key", "comma")):
            self.open.pop()
            return self._closed()
        return False


# Lines at depth 0 before which a new statement surely begins.
_BEGINS = {
    "js": re.compile(r"(?:import|export|const|let|var|function|class|interface|type|enum|async function|declare|abstract class|namespace)\b(?!\s*[.(=,:])"),
    "go": re.compile(r"(?:func|type|var|const|import)\b"),
    "py": re.compile(r"(?!(?:else|elif|except|finally)\b)[^\W\d]"),
}
_PY_DEFINES = re.compile(r"(?:async\s+def|def|class)\b")


def _plain(text: str, lang: str) -> str:
    """The text with comments and literals blanked out, as long as before."""
    spans = [(m.start(), m.end()) for m in _SQL_LEX.finditer(text)] if lang == "sql" else [(a, b) for _, a, b in lex(text, _LEXER[lang])[0]]
    parts, at = [], 0
    for start, end in spans:
        # A comment leaves nothing on its line, a literal leaves a sign: a line that it begins or ends is no statement's border.
        mark = " " if text.startswith(("//", "/*", "#", "--"), start) else "0"
        parts += [text[at:start], mark * (end - start)]
        at = end
    plain = "".join([*parts, text[at:]])
    if lang == "sql" and (m := re.search(r"['\"]|/\*|\$\w*\$", plain)):
        plain = plain[: m.start()]
    return plain


def sure_cut(text: str, lang: str) -> int:
    """The last place at which a new statement of the top level surely begins, or 0."""
    plain, depth, at, cut, before, decorated = _plain(text, lang), 0, 0, 0, "", False
    for line in plain.split("\n"):
        if depth == 0 and line.strip():
            if lang == "sql":
                sure = before.endswith(";")
            else:
                sure = bool(_BEGINS[_LEXER[lang]].match(line)) and (before.endswith((";", "}")) if _LEXER[lang] == "js" else not before.endswith("\\"))
                if lang == "py" and line[0] == "@":
                    sure, decorated = not decorated and not before.endswith("\\"), True
                elif lang == "py" and decorated:
                    sure, decorated = False, not _PY_DEFINES.match(line)
            if sure:
                cut = at
        if line.strip():
            before = line.rstrip()
        depth += sum(line.count(c) for c in "({[") - sum(line.count(c) for c in ")}]")
        at += len(line) + 1
    return cut


class StatementStream:
    """A source's text block by block: whole statements are parsed as they come, what is left open waits for the next block.

    A piece that doesn't fit stays open: only the whole rest decides, so that a doubtful cut never makes a valid file invalid.
    """

    def __init__(self, lang: str) -> None:
        self.lang, self.rest, self.begun, self.doubt = lang, [], False, False
        self.size, self.enough = 0, 0

    def _fits(self, text: str) -> bool:
        return not text.strip() or is_valid("package p\n" + text if self.begun and self.lang == "go" else text, self.lang)

    def feed(self, text: str) -> None:
        self.rest.append(text)
        self.size += len(text) + 1
        # A rest without a cut is looked at again when it has doubled, so that a long statement isn't read once per block.
        if self.doubt or self.size < self.enough:
            return
        whole = "\n".join(self.rest)
        cut = sure_cut(whole, self.lang)
        if cut and self._fits(whole[:cut]):
            self.rest, self.begun, self.enough = [whole[cut:]], True, 0
        else:
            self.rest, self.doubt, self.enough = [whole], cut > 0, 2 * len(whole)
        self.size = len(self.rest[0])

    def end(self) -> bool:
        return self._fits("\n".join(self.rest))


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for blocks in each_block(batches):
        rows = []
        for project, path, block, _, text in blocks:
            lang = LANGUAGES[path.rsplit(".", 1)[-1].lower()]
            blank = not text.strip()
            # A first block that is full may go on; any other block has one before it.
            if block > 0 or text.count("\n") >= BLOCK_LINES - 1:
                states = STATES[_LEXER[lang]] if lang in _LEXER and block else (CODE,)
                rows.append((project, path, block, lang, None, [dict(zip(_ENTRY, (state, *block_map(text, lang, state)), strict=True)) for state in states], text))
            else:
                rows.append((project, path, block, lang, None if blank else is_valid(text, lang), None, None))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_SEEN.values())], names=list(_SEEN))


_ENTRY = {"state": pa.string(), "leads_to": pa.string(), "summary": pa.string(), "conflict": pa.bool_()}
_SEEN = {"project": pa.string(), "path": pa.string(), "block": pa.int32(), "lang": pa.string(), "valid": pa.bool_(), "entries": pa.list_(pa.struct(list(_ENTRY.items()))), "text": pa.string()}


class _File:
    """A file of several blocks, as far as they were seen."""

    def __init__(self, lang: str) -> None:
        self.state, self.summary, self.holds, self.blank = CODE, "", True, True
        self.stream = JsonStream() if lang == "json" else StatementStream(lang)

    def feed(self, entries: list[dict], text: str) -> None:
        self.blank = self.blank and not text.strip()
        if self.holds:
            self.state, self.summary, conflict = join_block(self.state, self.summary, [tuple(e[k] for k in _ENTRY) for e in entries])
            self.holds = not conflict
            self.stream.feed(text)

    def valid(self) -> bool | None:
        return None if self.blank else self.holds and self.state == CODE and self.summary == "" and self.stream.end()


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of project, path and block: one row a file."""
    key, file = None, None
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            own = r["project"], r["path"], r["lang"]
            if key is not None and own != key:
                rows.append((*key, file.valid()))
                key = None
            if r["text"] is None:
                rows.append((*own, r["valid"]))
                continue
            if key is None:
                key, file = own, _File(r["lang"])
            file.feed(r["entries"], r["text"])
        yield _files(rows)
    if key is not None:
        yield _files([(*key, file.valid())])


def _files(rows: list[tuple]) -> pa.RecordBatch:
    names = ["project", "path", "lang", "valid"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _SEEN[name]) for k, name in enumerate(names)], names=names)


def judge_sources(chunks: DataFrame) -> DataFrame:
    """project, path, lang, valid: a row for each file with text whose ending names a language of LANGUAGES.

    Windows are put together by line number; repeated rows and rows of an earlier generation count once. Files of other endings,
    with null contents only or with blank text give no rows; nulls in project or path are no files; an empty table gives no rows.
    Files of more than BLOCK_LINES lines are read block by block; a task holds a block and the statement left open, of a file
    whose text doesn't fit the grammar all that follows.
    """
    sources = chunks.where(F.col("path").rlike(r"(?i)\.(" + "|".join(LANGUAGES) + ")$"))
    entry = "array<struct<state: string, leads_to: string, summary: string, conflict: boolean>>"
    seen = windows_by_block(sources).mapInArrow(_judge, f"project string, path string, block int, lang string, valid boolean, entries {entry}, text string")
    # Only blocks of long files bring their text along.
    ordered = seen.repartition("project", "path").sortWithinPartitions("project", "path", "block")
    return ordered.mapInArrow(_join, "project string, path string, lang string, valid boolean").where("valid is not null")


def invalid_rates(chunks: DataFrame) -> DataFrame:
    """project, lang, files, invalid, rate: per project and language, of the files with text."""
    files = judge_sources(chunks).groupBy("project", "lang").agg(F.count(F.lit(1)).alias("files"), F.count_if(~F.col("valid")).alias("invalid"))
    return files.withColumn("rate", F.col("invalid") / F.col("files"))
