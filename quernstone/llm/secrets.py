"""Credentials in source code and configuration, and their redaction (problem 5).

Literals near assignment contexts (an assignment, a header, a connection string, a password clause, a call's argument) are
segmented by Viterbi into dictionary words and unexplained rest. A long rest is a secret; in a context that names a secret a
value that people choose is one too. Placeholders, references, hashes, identifiers, public keys and data are not. The dictionary
is made of common words and of the words that files of several projects hold, each with a cost by how many chunks hold it.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.operators.files import WHOLE, each_block, join_windows, windows_by_block
from quernstone.session import spread

#: Unexplained characters of a literal that make a secret by themselves, and where the context names a secret.
REST_ALONE, REST_NAMED = 14, 5
#: Longer literals are data unless their name says secret; longer lines are looked at place by place.
LONGEST, LONG_LINE = 400, 4000

#: Words that the dictionary takes from the texts: in how many projects they have to be, their letters, and how many at most.
WORD_PROJECTS, WORD_LETTERS, MOST_WORDS = 3, (4, 20), 20_000

# Common words of code and of passwords that people choose.
_WORDS = frozenset(
    """access account action active admin alert alpha amount anchor api app apply archive array assign async auth authority base batch beta blue body book branch build button cache call cancel card case cell chunk
    claim class client close cloud code color command commit config connect content core count create css current custom data database date debug default delete demo deploy detail dev diff digest disabled document
    dragon edge email enabled end entry env error event example export fail false fetch field file filter find first flag folder form format function get global group guest handler hash header hello hidden home host
    html http icon image import index info inner input internal item job json key label lane last layout left length letmein level lib line link list load local lock log login long main manager map master max merge
    message meta method min mode model module monkey name nested network next node note null number object offset open option order outer output owner pad page part partial pass password patch path pin pool port post
    prefix primary private process prod product profile project public publish query queue random rank read ready record release remote replay report request reset result retry review right role room root route row rule run sample schema
    score script search secret select server service session set shared shift signed simple size source split stack start state static status stock store stream string style success summer sync system table target
    task team temp test text ticket time title token total trace true type unit update upload url use user utf value version view web webhook welcome wide width window winter work worker write zone""".split()
)
_UNIT_COST = math.log(40)


class Dictionary:
    """Words with their costs; ``counts`` are those of words in the texts, of ``total`` occurrences. Character costs are 1."""

    def __init__(self, counts: dict[str, int] | None = None, total: int = 0):
        usual = math.log(2000) / _UNIT_COST
        self.costs = {w: min(usual, len(w) - 0.5) for w in _WORDS}
        for word, n in (counts or {}).items():
            self.costs[word] = min(self.costs.get(word, len(word) - 0.5), max(0.5, math.log(total / n) / _UNIT_COST))
        self.longest = max(map(len, self.costs))
        self.unexplained = lru_cache(maxsize=50_000)(self._unexplained)

    def _unexplained(self, value: str) -> int:
        """Characters outside words, plain numbers and separators, by the segmentation of least cost.

        Viterbi over positions: a word costs what its frequency says, an unexplained character 1, a run of up to four digits 1, a
        separator 0.2. Case doesn't matter. The result counts the unexplained characters on the best path.
        """
        text = value.lower()
        n = len(text)
        best = [(0.0, 0)] + [(float("inf"), 0)] * n
        for i in range(n):
            cost, rest = best[i]
            c = text[i]
            plain = c.isalnum()
            steps = [(i + 1, cost + (1 if plain else 0.2), rest + plain)]
            if c.isdigit():
                j = i + 1
                while j < n and j < i + 4 and text[j].isdigit():
                    j += 1
                if j == n or not text[j].isdigit():
                    steps.append((j, cost + 1, rest))
            elif c.isalpha():
                for j in range(i + 3, min(n, i + self.longest) + 1):
                    if (word := self.costs.get(text[i:j])) is not None:
                        steps.append((j, cost + word, rest))
            for j, to, left in steps:
                if (to, left) < best[j]:
                    best[j] = (to, left)
        return best[n][1]


#: The dictionary that this worker looks words up in, by what it was made of.
_DICTIONARY: dict[str, Dictionary] = {"": Dictionary()}


def use_words(key: str, counts: dict[str, int]) -> None:
    """Look words up in a dictionary with these counts from now on; key tells dictionaries apart."""
    if key not in _DICTIONARY:
        made = Dictionary(counts, max(1, sum(counts.values())))
        _DICTIONARY.clear()
        _DICTIONARY[key] = made


def unexplained(value: str) -> int:
    """Characters of a value that no segmentation into the dictionary's words explains."""
    return next(iter(_DICTIONARY.values())).unexplained(value)


def words_of(chunks: DataFrame) -> dict[str, int]:
    """The words that several projects hold, with the number of chunks that hold each: of MOST_WORDS words those of most projects.

    A secret's random letters don't recur in several projects, its words do. All chunks count; copies of a chunk count once.
    """
    low, high = WORD_LETTERS
    own = spread(chunks.where("content is not null and project is not null").select("project", "content"))
    texts = own.select("project", F.xxhash64("content").alias("text"), F.array_distinct(F.transform(F.regexp_extract_all("content", F.lit(rf"[A-Za-z][a-z]{{{low - 1},{high - 1}}}(?![a-z])"), F.lit(0)), F.lower)).alias("words"))
    held = texts.select("project", "text", F.explode("words").alias("word")).groupBy("word", "project").agg(F.approx_count_distinct("text", 0.1).alias("n"))
    common = held.groupBy("word").agg(F.count(F.lit(1)).alias("projects"), F.sum("n").alias("n")).where(F.col("projects") >= WORD_PROJECTS)
    rows = common.orderBy(F.desc("projects"), F.desc("n"), "word").limit(MOST_WORDS).collect()
    return {r["word"]: int(r["n"]) for r in rows}


# Names of things that hold secrets.
_NAME = (
    r"pass(?:word|wd|phrase)?|pwd|secret|token|credentials?|contrase[nñ]a|clave(?:_\w+)?|passwort|kennwort|senha|mot_?de_?passe|jwt|bearer|auth|authorization|"
    r"api_?key|apikey|access_?key|secret_?key|private_?key|signing_?key|encryption_?key|pay_?key|stripe_?key|maps_?key|billing_?key|license_?key|service_?role|slack|bot|session|webhook_?secret|key"
)
_ASSIGN = re.compile(
    r"(?P<name>(?<![\w$])[\w$][\w$.-]*)(?:[\"'`]\]?)?\s*(?:\]\s*)?(?::\s*[A-Za-z_][\w<>\[\]| .]{0,30}\s*=|:=|=>|[:=])\s*"
    r"(?P<rest>\S.*)$"
)
_SECRET_NAME = re.compile(rf"(?:^|[_.\-$]|(?<=[a-z])(?=[A-Z]))(?:{_NAME})(?:[_.\-]?\d+)?$", re.I)
_PLAIN_NAME = re.compile(r"(?:hash|digest|sha\d*|md5|checksum|integrity|fingerprint|etag|commit|revision|trace|uuid|guid|public|cert|pattern|regex|version|_id|Id)(?:[_.\-]?\d+)?$")
_LITERAL = re.compile(r"(?P<q>[\"'`])(?P<v>(?:[^\"'`\\\n]|\\.|(?!(?P=q))[\"'`])*)(?P=q)")
_URL = re.compile(r"[a-z][a-z0-9+.-]*://(?P<user>[^\s:/@\"'<>${}]*):(?P<v>[^\s@/\"'<>{}`]{3,})@[\w.-]", re.I)
_HEADER = re.compile(r"\b(?P<scheme>Bearer|Basic|Token|Digest)\s+(?P<v>[A-Za-z0-9+/_.~=-]{8,})")
_FIELD = re.compile(r"\b(?:x-)?(?:api-?key|auth-?token|access-?token|authorization)[\"']?\]?\s*[:=]\s*[\"']?(?P<v>(?!Bearer|Basic|Token|Digest)[A-Za-z0-9+/_.~=-]{12,})", re.I)
_CLAUSE = re.compile(r"\b(?:password|identified by|pwd|passwd)\s*(?:=\s*)?(?P<q>['\"]?)(?P<v>[^\s'\";)]{6,})(?P=q)", re.I)
_FLAG = re.compile(r"(?:--?(?:password|pass|token|secret|api-key)[= ]|\s-u\s+\w+:)(?P<q>['\"]?)(?P<v>[^\s'\"]{6,})", re.I)
_PAIR = re.compile(r"\(\s*(?P<n>['\"][\w.-]+['\"])\s*,\s*(?P<q>['\"])(?P<v>[^'\"\n]{6,})(?P=q)\s*\)")
_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_BLOCK_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
# A key block that has no end: the rest of its line and all lines that hold nothing but key material.
_BODY = re.compile(r"[^\n]*(?:\n[^\S\n]*[\"'`+]*[^\S\n]*(?:(?:Proc-Type|DEK-Info):[^\n]*|[A-Za-z0-9+/=]*(?:\\n)?)[\"'`+,; \t\r]*(?=\n|\Z))*")
# Formats that only credentials have.
_KNOWN = re.compile(
    r"(?<![A-Za-z0-9_])(?:(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|gh[oprsu]_[A-Za-z0-9]{20,}|github_pat_\w{22,}|glpat-[\w-]{20,}|AKIA[0-9A-Z]{12,16}|ASIA[0-9A-Z]{16}|"
    r"AIza[\w-]{35}|ya29\.[\w-]{20,}|npm_[A-Za-z0-9]{30,}|hf_[A-Za-z0-9]{30,}|SG\.[\w-]{20,}\.[\w-]{20,}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}(?:\.[A-Za-z0-9_-]*)?)"
)
_SPLIT = re.compile(r"[\"'`]\s*(?:\+|\.|\\)?\s*$")
# Values that stand for a secret or refer to one.
_PLACEHOLDER = re.compile(
    r"^$|^<[^<>]*>$|[<>]|\$\{|\$\(|^\$\w|\{\{|^%|%\(|^(?:x{4,}|\*{3,}|\.{3,}|-+|_+|0+|1234\w*)$|"
    r"^(?:replace|change|fill|insert|enter|put|set)[ _-]?(?:me|this|in|it|here|your)?|"
    r"\b(?:example|placeholder|redacted|your[-_ ])|process\.env|os\.environ|getenv|vault|secret_?manager|readSecret|^(?:env|file|vault|ssm|arn|op|aws|gcp|secret):",
    re.I,
)
_HASHES = re.compile(r"^(?:(?:sha(?:1|224|256|384|512)|md5)[-:][\w+/=-]+|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{40}|[0-9A-F]{64}|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|\$(?:2[aby]|argon2\w*|5|6)\$.+|ssh-(?:rsa|ed25519) .*|#[0-9a-fA-F]{3,8})$", re.I)
# Words that a placeholder begins with; what follows them may be a secret all the same.
_STANDS_FOR = re.compile(r"(?:your|my|the|some|dummy|fake|example|sample|placeholder|todo|tbd|none|null|nil|undefined|true|false|redacted|secret|password|token|changeit|test|string|bearer|basic)(?:[ _-](?P<rest>.*))?$", re.I)
# Code instead of a value.
_CODE = re.compile(r"[(\[{]|^\w+(?:\.\w+)+$|\s(?:=|\+|\?|\|\||&&)\s|;$|,$")

# A line of an environment file: its value is a literal whatever it looks like, unless it opens something.
_ENV_LINE, _OPEN = re.compile(r"^\s*(?:export\s+)?[A-Z][A-Z0-9_]*=\S+\s*$"), re.compile(r"[(\[{]")


def classes(value: str) -> int:
    """How many of lower case, upper case, digits and other characters the value holds."""
    return sum((bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")))


def stands_for_one(value: str) -> bool:
    """Whether a value is a placeholder: one by its form, or one that begins as such and goes on in words."""
    if _PLACEHOLDER.search(value):
        return True
    m = _STANDS_FOR.match(value)
    return bool(m) and not (m["rest"] and len(m["rest"]) >= 8 and classes(m["rest"]) >= 3 and unexplained(m["rest"]) >= REST_NAMED)


def is_secret(value: str, named: bool, split: bool = False) -> bool:
    """Whether a literal is a credential: ``named`` if its context names a secret, ``split`` if it was put together of parts."""
    value = value.strip()
    if _KNOWN.search(value) and not re.search(r"[\[\]{}\\()*?]", value):
        return True
    if len(value) < 6 or len(value) > LONGEST and not named or stands_for_one(value) or _HASHES.match(value) or re.search(r"\s", value):
        return False
    if re.search(r"[\[\]{}\\]", value) or value.startswith(("/", "./", "../", "@/", "http")) and "@" not in value:
        return False
    kinds, rest = classes(value), unexplained(value)
    if re.fullmatch(r"[0-9a-fA-F]+", value):
        # Hexadecimal keys: a length that is no hash's, or a named one of 32.
        return len(value) >= 16 and (named or split)
    if named:
        if rest >= REST_NAMED and len(value) >= 8 and kinds >= 2:
            return True
        return len(value) >= 8 and kinds >= 3
    if split:
        return len(value) >= 10 and kinds >= 3
    return rest >= REST_ALONE and kinds >= 3 and 16 <= len(value) <= 80 and value.count("/") + value.count(".") <= 3 and not re.fullmatch(r"[A-Za-z]+(?:[-_/.][A-Za-z0-9]+)*", value)


def _basic(value: str) -> bool:
    """Whether base64 of user:password with a password."""
    try:
        plain = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("utf-8")
    except (binascii.Error, ValueError):
        return False
    user, colon, word = plain.partition(":")
    return bool(colon and user and len(word) >= 4 and not stands_for_one(word))


# Where a credential may stand: cheap to find, looked at closely line by line. Each part is wider than the detector it stands
# for. Words are found by an automaton in the lower-cased text, and what follows has to fit; all else begins with a sign.
_BEHIND = r"(?:[_.\-]?\d+)?[\"'`]?\]?[^\S\n]*(?:\][^\S\n]*)?[:=,\"'][^\n]{6}"
_VALUE = r"[^\S\n]*[^\s'\";)]*['\"=]"
_WORD_TRIGGERS = {
    # _SECRET_NAME before an assignment or a comma, _FIELD, _CLAUSE
    "pass": rf"pass(?:(?:word|wd|phrase|wort|e)?{_BEHIND}|(?:word|wd){_VALUE})", "pwd": rf"pwd(?:{_BEHIND}|{_VALUE})", "contrase": rf"contrase[nñ]a{_BEHIND}", "clave": rf"clave(?:_\w+)?{_BEHIND}", "service": rf"service_?role{_BEHIND}", "auth": rf"auth(?:orization)?{_BEHIND}",
    "credential": rf"credentials?{_BEHIND}", "identified by": rf"identified by{_VALUE}", **{w: rf"{w}{_BEHIND}" for w in ("secret", "kennwort", "senha", "jwt", "slack", "bot", "session", "key")},
    "token": rf"token(?:{_BEHIND}|[^\S\n]+[A-Za-z0-9+/_.~=-]{{8}})", "bearer": rf"bearer(?:{_BEHIND}|[^\S\n]+[A-Za-z0-9+/_.~=-]{{8}})",
    # _HEADER, _FLAG, _BLOCK
    **{w: rf"{w}[^\S\n]+[A-Za-z0-9+/_.~=-]{{8}}" for w in ("basic", "digest")}, **{f"-{w}": rf"-{w}[= ]" for w in ("password", "pass", "token", "secret", "api-key")}, "-u": r"-u[^\S\n]+\w+:", "private key": "private key",
    # _KNOWN
    **{w: re.escape(w) for w in ("sk_live_", "sk_test_", "rk_live_", "rk_test_", "pk_live_", "pk_test_", "github_pat_", "glpat-", "aiza", "ya29.", "akia", "asia")}, "xox": "xox[a-z]-", "npm_": r"npm_\w{30}", "hf_": r"hf_\w{30}",
    "sg.": r"sg\.[\w-]{20}", "eyj": r"eyj[\w-]{10}", **{f"gh{c}_": rf"gh{c}_\w" for c in "oprsu"},
}
_SIGN_TRIGGER = re.compile(
    r"[=:>(,|?$o\"'`](?:(?<=[=:>(,])[^\S\n]*[rbufRBUF]{0,2}[\"'`][^\S\n]*[^\s\"'`]\S{14,78}[^\s\"'`][^\S\n]*[\"'`]|(?<=\|)\|[^\S\n]*[\"'`]|(?<=\?)\?[^\S\n]*[\"'`]|(?<=o)r[^\S\n]*[\"'`]|"
    r"(?<=:)(?:-|//[^\s/@\"']*:[^\s/@\"']+@)|(?<=\$)\{\w+:=|(?<=[\"'`])[^\S\n]*\+[^\S\n]*\n)"
)


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    made = ahocorasick.Automaton()
    for word, pattern in _WORD_TRIGGERS.items():
        made.add_word(word, (len(word) - 1, re.compile(pattern, re.I).match))
    made.make_automaton()
    return made


_VALUE_END = re.compile(r"(?<=[\"'`\s])")


def trigger_places(text: str) -> list[int]:
    """Where a credential may stand, in order."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    places = [at - back for at, (back, fits) in _automaton().iter(low) if fits(text, at - back)]
    places += [m.start() for m in _SIGN_TRIGGER.finditer(text)]
    return sorted(places)


def find_secrets(text: str, first_line: int = 1) -> list[tuple[int, str, list[tuple[int, int]]]]:
    """(line, kind, spans to redact) of each credential that begins in the text; spans are offsets in the text."""
    found: list[tuple[int, str, list[tuple[int, int]]]] = []
    done, number, counted, past = -1, first_line, 0, 0
    places = trigger_places(text)
    for place in places:
        if place < past:
            continue
        begin = text.rfind("\n", 0, place) + 1
        if begin <= done:
            continue
        end = text.find("\n", place)
        past = end = len(text) if end < 0 else end
        number += text.count("\n", counted, begin)
        counted = begin
        done = begin
        line = text[begin:end]
        if b := _BLOCK.search(line):
            stop = _BLOCK_END.search(text, begin)
            after = _BLOCK.search(text, begin + b.end())
            if stop and after and after.start() < stop.start():
                stop = None
            body = text[begin + b.end() : stop.start() if stop else _BODY.match(text, begin + b.end()).end()]
            if not re.fullmatch(r"(?:[\s\\n\"'+]|REDACTEDx*)*", body) and len(re.sub(r"[^A-Za-z0-9+/=]", "", body)) >= 40:
                spans = [(begin + b.end() + w.start(), begin + b.end() + w.end()) for w in re.finditer(r"[A-Za-z0-9+/=]{8,}", body)]
                found.append((number, "private_key", spans))
                done = stop.start() if stop else begin
            continue
        if len(line) > LONG_LINE:
            # Of a very long line, the surroundings of each place are looked at, so that its length doesn't count twice.
            kind, spans = "", []
            for near in places[bisect.bisect_left(places, begin) : bisect.bisect_left(places, end)]:
                low, high = max(begin, near - 200), min(end, near + 2 * LONGEST)
                # A value that goes on beyond is looked at whole.
                high = m.start() if (m := _VALUE_END.search(text, high, end)) else end
                what, own, _ = _look_at(text, text[low:high], low, high)
                kind = kind or what
                spans.extend(x for x in own if not any(x[0] < y and w < x[1] for w, y in spans))
            if spans:
                found.append((number, kind, sorted(spans)))
            continue
        kind, spans, to = _look_at(text, line, begin, end)
        if spans:
            found.append((number, kind, spans))
            done = max(done, to)
    return found


def _look_at(text: str, line: str, begin: int, end: int) -> tuple[str, list[tuple[int, int]], int]:
    """kind, spans and the last line's beginning that the credential of this line reaches."""
    spans: list[tuple[int, int]] = []
    kind = ""

    def add(what: str, start: int, stop: int) -> None:
        nonlocal kind
        if not any(a <= begin + start < b for a, b in spans):
            kind = kind or what
            spans.append((begin + start, begin + stop))

    for m in _URL.finditer(line):
        v = m["v"]
        if not stands_for_one(v) and not v.startswith("$") and v.lower() not in ("pass", "password", "pwd", "user", "secret"):
            add("connection_string", m.start("v"), m.end("v"))
    for m in _HEADER.finditer(line):
        v = m["v"]
        if _basic(v) if m["scheme"] == "Basic" else is_secret(v, True):
            add("header", m.start("v"), m.end("v"))
    for m in _FIELD.finditer(line):
        if is_secret(m["v"], True) and not re.match(r"(?:process|os|env|req|config)\b", m["v"]):
            add("header", m.start("v"), m.end("v"))
    for m in _KNOWN.finditer(line):
        if is_secret(m.group(), True):
            add("known_format", m.start(), m.end())
    # A literal in parts: "..." + on the line's end goes on in the next line.
    if _SPLIT.search(line) and line.rstrip().endswith("+"):
        parts, at, stop = [], begin, end
        while True:
            own = text[at:stop]
            lits = list(_LITERAL.finditer(own))
            if not lits:
                break
            parts.append((lits[-1] if at == begin else lits[0], at))
            if not own.rstrip().endswith("+") or stop >= len(text):
                break
            at = stop + 1
            nxt = text.find("\n", at)
            stop = len(text) if nxt < 0 else nxt
        if len(parts) > 1:
            whole = "".join(p["v"] for p, _ in parts)
            a = _ASSIGN.search(line)
            named = bool(a and _SECRET_NAME.search(a["name"]) and not _PLAIN_NAME.search(a["name"]))
            plain = bool(a and _PLAIN_NAME.search(a["name"]))
            inner = _URL.search(whole)
            if not plain and ((inner and not stands_for_one(inner["v"])) or is_secret(whole, named, True)):
                kind = kind or "split_literal"
                spans.extend((o + p.start("v"), o + p.end("v")) for p, o in parts if not any(x <= o + p.start("v") < y for x, y in spans))
                return kind, spans, parts[-1][1]
    for m in _CLAUSE.finditer(line):
        before = line[: m.start()]
        if (m["q"] or "=" in m.group()) and is_secret(m["v"], True) and not re.search(r"[\w.]$", before):
            if m["q"] or not _CODE.search(m["v"]):
                add("password_clause", m.start("v"), m.end("v"))
    for m in _FLAG.finditer(line):
        if is_secret(m["v"], True) and not _CODE.search(m["v"]):
            add("flag", m.start("v"), m.end("v"))
    for m in _PAIR.finditer(line):
        name = m["n"][1:-1]
        if _SECRET_NAME.search(name) and is_secret(m["v"], True):
            add("pair", m.start("v"), m.end("v"))
    at = 0
    while m := _ASSIGN.search(line, at):
        at = m.start("rest")
        name, rest = m["name"], m["rest"]
        named = bool(_SECRET_NAME.search(name)) and not _PLAIN_NAME.search(name)
        plain = bool(_PLAIN_NAME.search(name))
        lits = list(_LITERAL.finditer(rest))
        if lits:
            for k, lit in enumerate(lits):
                before = rest[: lit.start()]
                # The value itself, or a fallback behind a reference to it.
                fallback = bool(re.search(r"(?:\|\||\?\?|\bor\b|,|:-)\s*$", before)) and bool(re.search(r"env|secret|config|getenv", before, re.I))
                direct = k == 0 and re.fullmatch(r"\s*(?:[rbuf]{0,2}|new\s+\w+\(|\w[\w.]*\()?\s*", before, re.I)
                env_name = re.search(r"(?:env\.|environ(?:\.get)?[\[(]\s*[\"']|getenv\(\s*[\"']|env\(\s*[\"'])([\w-]+)", before)
                own = named or bool(env_name and _SECRET_NAME.search(env_name[1]))
                if not (direct or fallback) or plain:
                    continue
                if direct and "(" in before and not own:
                    continue
                if re.search(r"(?:readSecret|getenv|environ|vault|secret\w*|lookup|get)\w*[\[(]\s*$", before, re.I) and not fallback:
                    continue
                if is_secret(lit["v"], own):
                    add("assignment" if direct else "fallback", m.start("rest") + lit.start("v"), m.start("rest") + lit.end("v"))
        elif named and not (_OPEN if _ENV_LINE.match(line) else _CODE).search(rest.strip()):
            v = rest.strip().split()[0].strip("\"',;")
            if is_secret(v, True) and classes(v) >= 3 - (unexplained(v) >= 8):
                add("assignment", m.start("rest") + rest.index(v), m.start("rest") + rest.index(v) + len(v))
        if d := re.search(r"\$\{[A-Za-z_]\w*:[-=](?P<v>[^}\s]{8,})\}", rest):
            if is_secret(d["v"], named):
                add("fallback", m.start("rest") + d.start("v"), m.start("rest") + d.end("v"))
    return kind, spans, begin


def _fill(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for start, end in sorted(spans):
        start = max(start, at)
        if start < end:
            out += [text[at:start], "REDACTED"[: end - start].ljust(end - start, "x")]
            at = end
    return "".join([*out, text[at:]])


def redact(text: str) -> str:
    """The text with every credential's characters replaced by as many of a filler, so that quotes, lines and offsets stay."""
    return _fill(text, [s for _, _, own in find_secrets(text) for s in own])


def _scan(key: str, held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_words(key, held.value)
        for blocks in each_block(batches):
            rows = []
            for project, path, _, first, text in blocks:
                for line, kind, spans in find_secrets(text, first):
                    rows.append((project, path, line, kind, min(a for a, _ in spans) - (text.rfind("\n", 0, min(a for a, _ in spans)) + 1)))
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["project", "path", "line", "kind", "column"])

    return run


def _held_words(chunks: DataFrame) -> tuple:
    """(key, broadcast) of the words of chunks: MOST_WORDS at most, so less than a megabyte."""
    counts = words_of(chunks)
    return sha256(repr(sorted(counts.items())).encode()).hexdigest(), chunks.sparkSession.sparkContext.broadcast(counts)


def find_credentials(chunks: DataFrame) -> DataFrame:
    """project, path, line, kind, column: a row for each line of a file on which a credential begins.

    Lines count from 1 in the file, columns from 0 in the line. Overlapping windows, repeated rows and rows of an earlier
    generation count once; null contents, projects and paths hold nothing; empty texts and tables give no rows.
    """
    return windows_by_block(chunks).mapInArrow(_scan(*_held_words(chunks)), "project string, path string, line int, kind string, column int")


def redact_windows(starts: list[int], texts: list[str]) -> list[str]:
    """The windows of one file, redacted by what the file put together of them shows. A window with a line of its own is also looked at alone."""
    if len(texts) == 1:
        return [redact(texts[0])]
    _, whole = join_windows(*zip(*sorted(set(zip(starts, texts, strict=True))), strict=True), block_lines=WHOLE)
    lines, begins = whole.split("\n"), [0, *(m.end() for m in re.finditer("\n", whole))]
    spans: dict[int, list[tuple[int, int]]] = {}
    for _, _, own in find_secrets(whole):
        for start, end in own:
            at = bisect.bisect_right(begins, start) - 1
            spans.setdefault(at, []).append((start - begins[at], end - begins[at]))
    out = []
    for s, text in zip(starts, texts, strict=True):
        own = text.split("\n")
        same = [lines[s - 1 + k] == line for k, line in enumerate(own)]
        if not all(same):
            own = redact(text).split("\n")
        out.append("\n".join(_fill(line, spans[s - 1 + k]) if same[k] and s - 1 + k in spans else line for k, line in enumerate(own)))
    return out


def _clean(key: str, held):
    """For mapInArrow over rows in order of their file: a file's rows at a time."""

    def done(rows: list[dict]) -> pa.RecordBatch:
        texts = redact_windows([r["s"] for r in rows], [r["content"] for r in rows]) if rows[0]["content"] is not None else [None]
        return pa.RecordBatch.from_arrays([pa.array([r["id"] for r in rows], pa.int64()), pa.array(texts, pa.string())], names=["id", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_words(key, held.value)
        file, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                # Rows that belong to no file stand alone.
                own = (r["project"], r["path"], r["generation"]) if r["whole"] else None
                if rows and (own is None or own != file):
                    yield done(rows)
                    rows = []
                file = own
                rows.append(r)
        if rows:
            yield done(rows)

    return run


def redact_chunks(chunks: DataFrame) -> DataFrame:
    """id, content: each chunk row with its credentials redacted; a null content stays null.

    What is a credential is seen on the file put together of a generation's windows, and redacted in every row that holds a line
    of it, so a window that begins inside a key block or a split literal is redacted too. Rows without project or path are
    looked at alone. A task holds the windows of one file and generation.
    """
    whole = F.col("project").isNotNull() & F.col("path").isNotNull() & F.col("content").isNotNull()
    generation = F.col("generation_id") if "generation_id" in chunks.columns else F.lit(None).cast("string")
    start = F.greatest(F.coalesce(F.col("start_line"), F.lit(1)), F.lit(1))
    rows = chunks.select("id", "project", "path", generation.alias("generation"), whole.alias("whole"), F.when(~whole, F.col("id")).alias("alone"), start.alias("s"), "content")
    files = ["project", "path", "generation", "alone"]
    return rows.repartition(*files).sortWithinPartitions(*files, "s").mapInArrow(_clean(*_held_words(chunks)), "id bigint, content string")
