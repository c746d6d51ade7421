"""Folding of balanced brackets and local grammars over what is left (problem 7).

Text is reduced to shapes: strings, numbers and names become single letters, comments vanish, and every innermost bracket pair is
replaced by one interned character, again and again, until no pair is left. What remains is a summary: brackets that found no
partner. Statements in which every bracket pair is one character are short and recur, so each distinct one is parsed once.
"""

from __future__ import annotations

import re

FIRST, LAST = 0xE000, 0xF8FF  # private-use characters stand for folded groups
WIDE_FIRST, WIDE_LAST = 0xF0000, 0x10FFFD


class Broken(Exception):
    """The text isn't valid."""


class Groups:
    """Interned contents of bracket pairs; a parser asks for the grammar that a pair has to fit where it stands."""

    LIMIT = 60_000

    def __init__(self) -> None:
        self.number: dict[str, str] = {}
        self.inside: dict[str, str] = {}

    def char(self, text: str) -> str:
        c = self.number.get(text)
        if c is None:
            n = len(self.number)
            c = self.number[text] = chr(FIRST + n) if n <= LAST - FIRST else chr(WIDE_FIRST + n - (LAST - FIRST + 1))
            self.inside[c] = text
        return c


_INNER = re.compile(r"\{[^{}()\[\]]*\}|\([^{}()\[\]]*\)|\[[^{}()\[\]]*\]")
_ANY = re.compile(r"[{}()\[\]]")
_PAIR = {")": "(", "]": "[", "}": "{"}


def fold(text: str, groups: Groups) -> str:
    """The text with every balanced pair replaced by its character."""
    if len(groups.number) > Groups.LIMIT:
        raise OverflowError
    n = 1
    take = lambda m: groups.char(m.group())
    while n:
        text, n = _INNER.subn(take, text)
    return text


def bracket_summary(text: str) -> str:
    """The brackets without partner in the text, in order. Summaries of neighbouring texts are combined by ``join_summaries``."""
    out: list[str] = []
    for c in _ANY.findall(text):
        if c in "({[":
            out.append(c)
        elif out and out[-1] == _PAIR[c]:
            out.pop()
        else:
            out.append(c)
    return "".join(out)


def join_summaries(left: str, right: str) -> str:
    """Associative: the summary of two texts side by side."""
    return bracket_summary(left + right)


class Parser:
    """Recursive descent over the tokens of a shape; subclasses hold the grammars. ``fits`` remembers results per shape and rule."""

    tokens = re.compile(r"\S")

    def __init__(self) -> None:
        self.groups = Groups()
        self.known: dict[tuple[str, str], bool] = {}
        self.t, self.p = [""], 0

    def reset(self) -> None:
        self.groups, self.known = Groups(), {}

    KNOWN_LIMIT = 300_000

    def fits(self, rule: str, text: str) -> bool:
        key = (rule, text)
        got = self.known.get(key)
        if got is None:
            if len(self.known) > self.KNOWN_LIMIT:
                self.known.clear()
            saved = self.t, self.p
            self.t, self.p = [*self.tokens.findall(text), ""], 0
            try:
                getattr(self, rule)()
                got = self.t[self.p] == ""
            except Broken:
                got = False
            except RecursionError:
                got = True  # nested too deeply to tell; its brackets have their partners
            self.t, self.p = saved
            self.known[key] = got
        return got

    # -- helpers of the grammars
    def at(self, *texts: str) -> bool:
        return self.t[self.p] in texts

    def take(self, *texts: str) -> bool:
        if self.t[self.p] in texts:
            self.p += 1
            return True
        return False

    def need(self, *texts: str) -> None:
        if self.t[self.p] not in texts:
            raise Broken
        self.p += 1

    def bracket(self) -> str:
        """Which bracket the group at this place has, or ''."""
        return self.groups.inside.get(self.t[self.p], " ")[0].strip()

    def inner(self, bracket: str, *rules: str) -> None:
        """A group of this bracket, whose inside fits one of the rules."""
        text = self.groups.inside.get(self.t[self.p])
        if text is None or text[0] != bracket:
            raise Broken
        body = text[1:-1]
        if not any(self.fits(rule, body) for rule in rules):
            raise Broken
        self.p += 1

    def attempt(self, rule) -> bool:
        """Try a rule; on failure go back."""
        p = self.p
        try:
            rule()
            return True
        except Broken:
            self.p = p
            return False

    # The rule for one statement of each rule for many that ``lines`` is used with, and what may stand between two of them.
    single: dict[str, tuple] = {}
    between: tuple[str, ...] = ("\n",)

    def lines(self, rule: str, text: str, most: int = 60) -> bool:
        """Whether the lines of a text fall into statements, each of one or more lines that fit the rule together.

        Statements of up to ``most`` lines are tried in every way; where none fits, longer ones are read as far as they go.
        """
        rows = [x for x in text.split("\n") if x]
        good, back = [True] + [False] * len(rows), [0] * (len(rows) + 1)
        j, last = 1, 0
        while j <= len(rows):
            part = ""
            for i in range(j - 1, max(-1, j - 1 - most), -1):
                part = rows[i] + "\n" + part if part else rows[i]
                if good[i] and self.fits(rule, part):
                    good[j], back[j], last = True, i, j
                    break
            if not good[j] and j > most and (j == len(rows) or j - last >= most):
                # The statement may have begun at any border seen lately, or where the one that ended there began.
                starts = {k for i in range(max(0, last - most), last + 1) if good[i] for k in (i, back[i])}
                start, end = self.reach(rule, rows, starts, last)
                if not end:
                    return False
                good[end], back[end], last, j = True, start, end, end
            j += 1
        return good[-1]

    def reach(self, rule: str, rows: list[str], starts: set[int], behind: int) -> tuple[int, int]:
        """(start, end) of the first line border behind a line to which whole statements reach from one of the starts, the latest first, or (0, 0)."""
        saved = self.t, self.p
        low = min(starts)
        tokens, places = [], {}
        for k, row in enumerate(rows[low:], low):
            places[k] = len(tokens)
            tokens += [*self.tokens.findall(row), "\n"]
        places[len(rows)] = len(tokens)
        ends = {p - 1: k for k, p in places.items() if p}
        self.t = [*tokens[:-1], ""]
        name, *arguments = self.single[rule]
        try:
            for start in sorted(starts, reverse=True):
                self.p = places[start]
                try:
                    while not self.at(""):
                        while self.at(*self.between):
                            self.p += 1
                        getattr(self, name)(*arguments)
                        if ends.get(self.p, 0) > behind:
                            return start, ends[self.p]
                except (Broken, RecursionError):
                    continue
        finally:
            self.t, self.p = saved
        return 0, 0
