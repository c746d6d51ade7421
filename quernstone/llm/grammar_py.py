"""Local grammar of Python: logical lines as folded shapes, each distinct shape parsed once, and the blocks they make.

Comments vanish, names and literals become single signs, every bracket pair one character. What is left of a logical line is
short and recurs; a line that wasn't seen yet is parsed by itself, a clause with the least statement that it may stand in. How
clauses and indented blocks may follow each other is checked here, line by line.
"""

from __future__ import annotations

import ast
import keyword
import re
import warnings

from quernstone.llm.grammar import Groups, fold

_TRIPLE = r"\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*+'''"
_SINGLE = r"\"(?:[^\"\\\n]|\\[\s\S])*+\"|'(?:[^'\\\n]|\\[\s\S])*+'"
_LEX = re.compile(rf"(?P<comment>#[^\n]*)|(?<!\w)(?P<prefix>[A-Za-z]{{0,2}})(?P<body>{_TRIPLE}|(?!\"\"\"|''')(?:{_SINGLE}))|\\\n")
_GOES_NOWHERE = re.compile(r"\\\n[ \t\f]*(?:\n|\Z)")
_ESCAPE = re.compile(r"\\[xuUN0-7]")
_NAME = re.compile(r"(?<!\w)[^\W\d]\w*")
_INTEGER = re.compile(r"(?<![\w.])(?:0|[1-9][0-9]*)(?![\w.])")
_KEEP = frozenset([*keyword.kwlist, "match", "case", "type", "_"])
_WORD = re.compile(r"(?:async\s+)?\w+")
_PAIRS = {"{": "}", "(": ")", "[": "]"}
# What a clause is parsed with, before and behind it.
_AROUND = {"elif": ("if a:pass\n", ""), "else": ("if a:pass\n", ""), "except": ("try:pass\n", ""), "finally": ("try:pass\n", ""), "try": ("", "\nfinally:pass"), "@": ("", "\ndef a():pass")}
# clause: what it may follow, by what the chain then is. A chain that is still 'try' isn't whole.
_FOLLOWS = {"elif": {"if": "if"}, "else": {"if": "", "loop": "", "except": "try else", "except*": "try else"}, "finally": dict.fromkeys(("try", "except", "except*", "try else"), "")}
_BEGINS = {"if": "if", "for": "loop", "while": "loop", "async for": "loop", "try": "try"}


class Py:
    """Checks texts of Python 3; what it has seen stays with it."""

    LIMIT = 300_000

    def __init__(self) -> None:
        self.groups, self.known = Groups(), {}

    def check(self, text: str) -> bool:
        if len(self.groups.number) > Groups.LIMIT or len(self.known) > self.LIMIT:
            self.groups, self.known = Groups(), {}
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        plain = _LEX.sub(self._literal, text)
        if '"' in plain or "'" in plain or _GOES_NOWHERE.search(text):
            return False
        plain = _INTEGER.sub("0", _NAME.sub(self._name, plain))
        return self._blocks(fold(plain, self.groups).split("\n"))

    @staticmethod
    def _name(m: re.Match) -> str:
        word = m.group()
        return word if word in _KEEP else "a" if word.isidentifier() else "?"

    def _literal(self, m: re.Match) -> str:
        if m["comment"] is not None:
            return ""
        if m["body"] is None:
            return " "  # a line that goes on
        prefix, body = m["prefix"].lower(), m["body"]
        kind = "".join(sorted(prefix.replace("r", "")))
        if kind == "b" and prefix.count("r") < 2 and body.isascii() and ("r" in prefix or not _ESCAPE.search(body)):
            return self.groups.char(" b'' ")
        if prefix in ("", "r", "u") and (prefix == "r" or not _ESCAPE.search(body)):
            return self.groups.char(" '' ")
        # A literal in which something may be wrong is parsed as it stands.
        return self.groups.char(f" {m.group()} ")

    def _whole(self, shape: str) -> str:
        """The text that a shape stands for; within brackets, lines don't count."""
        inside, out, stack = self.groups.inside, [], [iter(shape)]
        while stack:
            c = next(stack[-1], None)
            if c is None:
                stack.pop()
            elif (text := inside.get(c)) is None:
                out.append(" " if c == "\n" else c)
            elif text[0] in _PAIRS:
                stack.append(iter(text))
            else:
                out.append(text)
        return "".join(out)

    def _parses(self, shape: str, before: str, behind: str) -> bool:
        key = before, shape
        got = self.known.get(key)
        if got is None:
            try:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    compile(before + self._whole(shape).strip() + behind, "line", "exec", ast.PyCF_ONLY_AST, dont_inherit=True)
                got = True
            except (RecursionError, MemoryError):
                got = True
            except (SyntaxError, ValueError):
                got = False
            self.known[key] = got
        return got

    def _blocks(self, lines: list[str]) -> bool:
        # Of each open block: its columns by tabs of 8 and of 1, the chain that its last statement began, whether it holds cases.
        columns, chains, cases = [(0, 0)], [""], [False]
        opened, decorated, is_match = False, False, False
        for line in lines:
            shape = line.strip(" \t\f")
            if not shape:
                continue
            column = _columns(line)
            if opened:
                if column[0] <= columns[-1][0] or column[1] <= columns[-1][1]:
                    return False
                columns.append(column)
                chains.append("")
                cases.append(is_match)
                opened = False
            elif column != columns[-1]:
                while column[0] < columns[-1][0]:
                    if chains.pop() == "try" or decorated:
                        return False
                    columns.pop()
                    cases.pop()
                if column != columns[-1]:
                    return False
            m = _WORD.match(shape)
            word = " ".join(m.group().split()) if m else "@" if shape[0] == "@" else ""
            opened = shape[-1] == ":"
            is_match = opened and word == "match"
            if decorated and word not in ("def", "class", "async def", "@"):
                return False
            decorated = word == "@"
            if cases[-1]:
                if word != "case" or not self._parses(shape + ("pass" if opened else ""), "match a:\n ", ""):
                    return False
                continue
            before, behind = _AROUND.get(word, ("", ""))
            if is_match:
                behind = "\n case a:pass"
            if not self._parses(shape + ("pass" if opened and not is_match else ""), before, behind):
                return False
            chain = chains[-1]
            if word == "except":
                own = "except*" if shape[6:].lstrip().startswith("*") else "except"
                if chain not in ("try", own):
                    return False
                chains[-1] = own
            elif word in _FOLLOWS:
                if chain not in _FOLLOWS[word]:
                    return False
                chains[-1] = _FOLLOWS[word][chain]
            elif chain == "try":
                return False
            else:
                chains[-1] = _BEGINS.get(word, "")
        return not opened and not decorated and "try" not in chains


def _columns(line: str) -> tuple[int, int]:
    """The column of a line's first sign with tabs of 8 and of 1."""
    wide = narrow = 0
    for c in line:
        if c == " ":
            wide, narrow = wide + 1, narrow + 1
        elif c == "\t":
            wide, narrow = (wide // 8 + 1) * 8, narrow + 1
        elif c == "\f":
            wide = narrow = 0
        else:
            break
    return wide, narrow
