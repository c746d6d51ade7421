"""Files that nobody of the project wrote by hand (problem 4).

Evidence per file: its path (output and package folders, lock files), what it holds (marks of generators, of minifiers and
transpilers, of copies of other people's code, data saved as code), the reason given for it, and recurrence: winnowed
fingerprints of normalised token streams, of which a copied file shares nearly all with files of many unrelated projects.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.operators.files import each_block, windows_by_block
from quernstone.session import cut

#: Tokens of a fingerprint, hashes of a winnowing window (shared runs of RUN + WINDOW - 1 tokens are always seen).
RUN, WINDOW = 25, 15
#: A fingerprint recurs if this many projects hold it; a file is a copy if so large a share of its own recur.
PROJECTS, SHARE = 2, 0.7

# Folders that hold output or packages, whatever lies in them.
_FOLDERS = (
    "node_modules|bower|bower_components|jspm_packages|site-packages|vendor|vendored|third[_-]?party|extern|externals?|deps|"
    "dist|build|out|coverage|_?_?generated_?_?|autogen|__generated__|\\.next|\\.nuxt"
)
# Folders whose names also are words of a project's own domain: where there is text, it decides.
_MAYBE = re.compile(r"(?:^|/)(?:bundles?|outputs?|targets?|obj)/", re.I)
_PATH = re.compile(rf"(?:^|/)(?:{_FOLDERS})/", re.I)
_LOCK = re.compile(r"(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|bun\.lockb?|deno\.lock|poetry\.lock|pipfile\.lock|cargo\.lock|composer\.lock|gemfile\.lock|go\.sum|uv\.lock|mix\.lock)$", re.I)
# Names that only a tool gives.
_TOOL_NAME = re.compile(r"(?:\.pb\.go|_pb2(?:_grpc)?\.py|\.pb\.(?:cc|h)|_string_gen\.go|_autogen\.\w+|\.autogen\.\w+)$|(?:^|/)zz_generated[\w.]*$", re.I)
# Names that tools give and people may; where there is text, it has to agree.
_NAME = re.compile(
    r"(?:[.-]min\.(?:js|mjs|css)|\.bundle\.js|\.chunk\.js|\.compiled\.js|\.es5\.js|\.pb\.go|_pb2(?:_grpc)?\.py|\.pb\.(?:cc|h)|_string_gen\.go|_gen\.go|_autogen\.\w+|\.autogen\.\w+|"
    r"\.gen\.\w+|\.generated\.\w+|\.g\.dart|\.base64\.\w+|_blob\.\w+|_dump\.\w+|\.data\.\w+)$|(?:^|/)zz_generated[\w.]*$",
    re.I,
)
_GENERATED = re.compile(
    r"code generated by|\bmade by (?:gnu )?\w+,? (?:version )?\d+\.\d+|@generated\b|auto-?generated\b|machine made|machine[- ]generated|generated (?:by|from|with|using) \S+|this file (?:was|is) (?:auto\w* )?(?:written|generated|created|produced) by|changes to it will be lost|do not (?:edit|modify)\b|please do not modify|"
    r"maschinell\b.{0,60}\berzeugt|automatisch (?:erzeugt|generiert)|(?:creado|generado) autom[áa]ticamente|no (?:modificar|editar) a mano|g[ée]n[ée]r[ée] automatiquement|ne pas modifier|gerado automaticamente|n[ãa]o editar",
    re.I,
)
# A generator's mark names the tool or forbids the edit; a sentence about generated things is none.
_SPEAKS = re.compile(r"\b(?:is|are|was|be) generated by the (?:server|client|build|worker|tool)\b|\bmust not be edited\b", re.I)
_COPIED = re.compile(
    r"\| ?\(c\) (?:the )?[\w-]+ (?:authors|contributors)|imported from the [\w-]+ distribution|bundled copy of|taken unchanged from|send fixes to\s+upstream|toolkit for browsers|see\s+upstream for licen[cs]e|released under a permissive\s+licen[cs]e|"
    r"copyright (?:\(c\)|©)? ?\d{4}.{0,80}\b(?:authors|contributors|inc|ltd|gmbh|foundation)\b|/\*!\s*(?:\*\s*)?(?:[\w.@/-]+ ){1,5}v?\d+\.\d+|@preserve|@license\b",
    re.I,
)
_TRANSPILED = re.compile(r'Object\.defineProperty\(exports, ?"__esModule"|\b__(?:awaiter|generator|extends|importDefault|importStar|rest|assign) ?= ?\(this && this\.__|_interopRequireDefault\(|_classCallCheck\(|//# sourceMappingURL=')
_BLOB = re.compile(r"[A-Za-z0-9+/=_-]{160,}")
_NUMBERS = re.compile(r"^[\s\[\]{}(),]*(?:-?(?:0x[0-9a-fA-F]+|\d+(?:\.\d+)?)[\s,\]})]*){6,};?$", re.M)
_MADE = re.compile(r"_rt\.build\(b\"[0-9a-f]{60,}|^export interface Op\d+\w+Body \{", re.M)
_TOKEN = re.compile(rb"[\w\x80-\xff]+")
_HEAD = re.compile(r"\s*(?:(?:#!|<\?)[^\n]*\n)?\s*((?:/\*.*?\*/\s*|(?://|#|--|;|<!--)[^\n]*\n\s*|\"\"\".*?\"\"\"\s*)+)", re.S)
_CODE = re.compile(r"\.(?:tsx?|jsx?|mjs|cjs|py|go|sql|sh|java|rb|rs|c|cc|cpp|h|cs|php|kt|scala|swift|css)$", re.I)
# What a reason says of files that are not hand-written; none of it is needed, and a text by hand outweighs it.
_REASON = (
    r"(?i)emitted by|bundler output|empaquetador|schema compiler|transpiler result|regenerated on|binary table|exported from a spreadsheet|squeezed for|not ours|copia de la biblioteca|upstream copy|third-party sources|produced from .* definitions|"
    r"^(?:auto-?)?generated by|vendored|minified"
)


def path_evidence(path: str) -> str | None:
    """'folder', 'lock', 'maybe' or 'name', or None."""
    if _LOCK.search(path):
        return "lock"
    if _PATH.search(path):
        return "folder"
    if _MAYBE.search(path):
        return "maybe"
    return "name" if _NAME.search(path) else None


def text_evidence(path: str, text: str) -> str | None:
    """What the text shows: 'generated', 'copied', 'transpiled', 'minified', 'data', or None."""
    head = _HEAD.match(text + "\n")
    if head:
        # The words of the leading comment, without comment marks at the line starts.
        words = re.sub(r"\s+", " ", re.sub(r"^[ \t]*(?:/\*+|\*+/?|//+!?|#+|--+|;+)", " ", head.group(1), flags=re.M))
        if _COPIED.search(words) or _COPIED.search(head.group(1)):
            return "copied"
        if _GENERATED.search(_SPEAKS.sub(" ", words)):
            return "generated"
    if _TRANSPILED.search(text):
        return "transpiled"
    if _MADE.search(text):
        return "generated"
    code = bool(_CODE.search(path))
    if code and len(text) >= 400:
        n = len(text)
        blobs = sum(len(m) for m in _BLOB.findall(text))
        if blobs >= 0.6 * n:
            return "data"
        if "0x" in text or text.count(",") * 4 >= n * 0.5:
            if sum(len(m.group()) for m in _NUMBERS.finditer(text)) >= 0.6 * n:
                return "data"
        lines = text.split("\n")
        long = sum(len(x) for x in lines if len(x) >= 500)
        if long >= 0.6 * n and sum(text.count(c) for c in " \t\n") <= 0.1 * n:
            return "minified"
    return None


_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers(n: int):
    """base**i and base**-i for i up to n, modulo 2**64."""
    import numpy as np

    inverse = pow(_BASE, -1, 1 << 64)
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(x), dtype=np.uint64)])) for x in (_BASE, inverse))


def _tokens(text: str) -> list[bytes]:
    head = _HEAD.match(text)
    return _TOKEN.findall((text[head.end() :] if head else text).encode("utf-8", "replace"))


def fingerprints(text: str, run: int = RUN, window: int = WINDOW) -> list[int]:
    """Winnowed hashes of the text's runs of tokens: the words and numbers; white space and punctuation don't count, nor does a leading comment."""
    return _winnow(_tokens(text), run, window)


def _winnow(tokens: list[bytes], run: int, window: int) -> list[int]:
    from zlib import crc32

    import numpy as np

    n = len(tokens)
    if n < run:
        return []
    h = np.fromiter(map(crc32, tokens), dtype=np.uint64, count=n)
    size = 1 << 16
    while size < n:
        size *= 2
    down, up = _powers(size)
    # The prefix sums of h[i] * base**-i give every run's polynomial in one difference.
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(h * up[:n], out=prefix[1:])
    rolled = (prefix[run:] - prefix[: n - run + 1]) * down[: n - run + 1]
    rolled ^= rolled >> np.uint64(29)
    rolled *= np.uint64(0xBF58476D1CE4E5B9)
    rolled ^= rolled >> np.uint64(32)
    least, width = rolled, 1
    while width < window and len(least) > 1:
        step = min(width, window - width, len(least) - 1)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return np.unique(least).view(np.int64).tolist()


def prints_of(text: str) -> list[int]:
    """The fingerprints, or for a text shorter than one winnowing window a hash of all its tokens."""
    tokens = _tokens(text)
    if len(tokens) >= RUN + WINDOW - 1:
        return _winnow(tokens, RUN, WINDOW)
    return [int.from_bytes(blake2b(b" ".join(tokens), digest_size=8).digest(), "little", signed=True)] if tokens else []


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for blocks in each_block(batches):
        rows = [(project, path, block, text_evidence(path, text), prints_of(text)) for project, path, block, _, text in blocks]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["project", "path", "block", "seen", "prints"])


def recurring_share(texts: DataFrame, projects: int = PROJECTS) -> DataFrame:
    """project, path, prints, share: how many distinct fingerprints a file has, and the share of them that ``projects`` projects hold.

    texts: project, path, prints (an array, distinct), a row per file. A fingerprint is counted per project first, so one that
    nearly every file holds costs a project one row; it then joins back by its value, and AQE splits the partition of a hot one.
    Files and projects go along as hashes of 96 and 64 bits, names stay behind.
    """
    file = [F.xxhash64("project", "path").alias("f"), F.hash("project", "path").alias("g")]
    prints = texts.where("size(prints) > 0").select(*file, F.xxhash64("project").alias("p"), F.explode("prints").alias("print"))
    held = prints.groupBy("print", "p").agg(F.lit(1).alias("one")).groupBy("print").agg(F.count(F.lit(1)).alias("projects")).where(F.col("projects") >= projects)
    shares = prints.select("f", "g", "print").join(held.select("print", F.lit(1).alias("hit")), "print", "left").groupBy("f", "g").agg(F.count(F.lit(1)).alias("prints"), (F.count("hit") / F.count(F.lit(1))).alias("share"))
    return texts.select("project", "path", *file).join(shares, ["f", "g"]).select("project", "path", "prints", "share")


def judge_files(listed: DataFrame, chunks: DataFrame) -> DataFrame:
    """project, path, evidence: of each listed file that nobody wrote by hand, what shows it.

    A file in an output or package folder or a lock file is one whatever it holds. Otherwise its text decides; a telling name or
    reason counts only where there is no text. Duplicate rows give one row; a null project or path is no file; null reasons and
    authorities say nothing; files without chunks are judged by path and reason. Empty tables give no rows.
    """
    files = listed.where("project is not null and path is not null").groupBy("project", "path").agg(F.max(F.coalesce(F.col("reason"), F.lit("")).rlike(_REASON)).alias("told"))
    seen = windows_by_block(chunks).mapInArrow(_look, "project string, path string, block int, seen string, prints array<bigint>")
    texts = seen.groupBy("project", "path").agg(F.min_by("seen", F.when(F.col("seen").isNotNull(), F.col("block"))).alias("seen"), F.flatten(F.collect_list("prints")).alias("prints"))
    # Both the fingerprints and the evidence are read below: looked at once.
    texts = cut(texts.select("project", "path", "seen", F.array_distinct("prints").alias("prints")))
    shares = recurring_share(texts)
    lower = F.lower("path")
    native = (
        F.when(lower.rlike(_LOCK.pattern.replace("(?i)", "")), "lock").when(lower.rlike(_PATH.pattern), "folder").when(lower.rlike(_NAME.pattern), "name")
    )
    joined = files.join(texts.select("project", "path", F.lit(True).alias("has_text"), "seen"), ["project", "path"], "left").join(shares, ["project", "path"], "left")
    evidence = (
        F.when(native.isin("lock", "folder"), native)
        .when(F.col("seen").isNotNull(), F.col("seen"))
        .when(F.col("share") >= SHARE, "recurring")
        .when(F.col("has_text").isNull() & native.isNotNull(), native)
        .when(F.col("has_text").isNull() & lower.rlike(_MAYBE.pattern), "folder")
        .when(F.col("has_text").isNull() & F.col("told"), "reason")
        .when(F.col("has_text") & (F.lower("path").rlike(_TOOL_NAME.pattern) | (native.isNotNull() & F.col("told"))), native)
    )
    return joined.select("project", "path", evidence.alias("evidence")).where("evidence is not null")
