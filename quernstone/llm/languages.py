"""Natural language inside source code: comments and string literals, their language and share of each file (problem 1).

Spans are taken from each file, deduplicated by a 128-bit hash, classified once each, and the labels are joined back to the
files to weigh their bytes.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.lexing import CODE, ENDINGS, STATES, entry_states, language, language_of, lex
from quernstone.operators.files import each_block, windows_by_block
from quernstone.session import cut

#: Words, or Chinese characters, that make a span a text.
LEAST_WORDS, LEAST_HAN = 6, 12

# Words that hold sentences together, without accents, per language.
_FUNCTION_WORDS = {
    "en": "the a an of to in is are was were be been and or not that this these those it its as at by for from with without on which who when while until unless because so but if than then there here must should has have had does do only every each any all can could will would into after before never no used out up what where how may our your their we you they once still instead",
    "es": "el la los las un una unos de del al que y o en es son era fue ser se no por para con sin sobre como mas pero cuando hasta si porque aunque mientras solo solamente cada todo toda esta este esto estos ya su sus lo le nunca a desde entre hay debe deben tiene tienen puede antes despues ni donde quien cual hace",
    "de": "der die das den dem des ein eine einen einem einer und oder nicht ist sind war wird werden wurde zu zum zur von vom mit ohne auf aus bei nach vor fur als wie dass weil wenn bis aber auch nur noch schon es sich im in an am hier diese dieser dieses jede jeder jedes muss darf kann hat haben niemals solange damit deshalb durch um",
    "fr": "le la les un une des du de l d que qu et ou en est sont etait ne pas plus par pour avec sans sur comme mais quand si ce cet cette ces se sa son ses leur aux au dans il elle on nous vous doit doivent etre ete a ont lorsque jamais tant parce aussi meme tout toute chaque apres avant c s y n j jusqu seulement",
    "pt": "o a os as um uma uns de do da dos das no na nos nas que e ou em se nao por para com sem sobre como mais mas quando ate porque embora enquanto so somente cada todo toda esta este isto estes ja seu sua ao aos pelo pela ser foi sao tem deve devem pode nunca antes depois mesmo que isso nem onde quem",
}
# Words of other languages that none of those above has: texts in them are natural language, but not one of these.
_OTHERS = {
    "nl": "het een van voor met niet wordt worden moet zijn naar bij dat deze dit wel maar omdat wanneer zonder tussen alle geen ook nog",
    "it": "il gli della delle dei degli nel nella che non sono viene deve quando anche questo questa dopo prima senza tra fra perche ogni",
    "sv": "och att det inte som till av med ska maste nar innan efter utan alla detta denna ar blir",
    "pl": "nie jest sie oraz przez dla przed jesli tylko kazdy gdy czy ktory ktora musi byc jako aby",
    "tr": "ve bir bu icin ile degil daha sonra gibi kadar her olarak ancak veya olan",
}
_MARKS = {"es": "ñ¿¡", "de": "ßäöü", "fr": "çèêëîïœùûàâ", "pt": "ãõç"}
_LISTS = {lang: frozenset(words.split()) for lang, words in _FUNCTION_WORDS.items()}
# word: the languages that use it; the fewer they are, the more it tells.
_USED_BY = {w: tuple(lang for lang, own in _LISTS.items() if w in own) for words in _LISTS.values() for w in words}
_RIVALS = {lang: frozenset(words.split()) - frozenset(_USED_BY) for lang, words in _OTHERS.items()}
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_PART = re.compile("[ '’-]")
_HAN = re.compile(r"[㐀-䶿一-鿿]")
_CYRILLIC = re.compile(r"[а-яёА-ЯЁ]+")
# Insertions, escapes, addresses and paths hold no words.
_NOISE = re.compile(r"\$\{[^{}]*\}|\{[^{}\n]{0,60}\}|%\(\w+\)[sd]|%[sdvqfxr]|\\[nrtb0\"'`\\]|\\u[0-9a-fA-F]{4}|\b(?:https?|ftp|file|git|ssh)://\S+|\S*[\w)]/[\w.]\S*|\S+@\S+|`[^`\n]*`|\b\w+\([^()\n]*\)|\b\w*\d\w*\b|\b[a-z]+[A-Z]\w*|\b\w+_\w+\b|<[^<>\n]{1,80}>")
_SQL = re.compile(r"^\s*(?:select\b[\s\S]+\bfrom\b|insert\s+into\b|update\s+\w+\s+set\b|delete\s+from\b|create\s+(?:or\s+replace\s+)?(?:unique\s+)?(?:table|index|view|function|policy|trigger|type)\b|alter\s+\w+\b|with\s+\w+\s+as\s*\(|drop\s+\w+\b|grant\s|where\s|order\s+by\b|join\s|group\s+by\b)", re.I)
_CODE_LINE = re.compile(r"[=()\[\]{}].*;\s*$|[{}]\s*$|^\s*(?:const|let|var|return|if|for|while|import|export|function|def|class|else|elif|try|catch|switch|case|await|async|from \S+ import|package|func|type|select|insert|update|delete|create|alter)\b.*[(){}=;:\[\]]|^\s*[\w.\[\]\"']+\s*(?::=|[-+*/]?=)\s*\S|^\s*[\w.]+\([^)]*\)[;,]?\s*$|=>|&&|\|\||^\s*[)}\]]+[;,]?\s*$|^\s*[<>=]{7}|^\s*@?\w+(?:\.\w+)+\s*$")
_DIRECTIVE = re.compile(r"^\s*(?:eslint|prettier|tslint|noqa|type:|pylint|nolint|istanbul|ts-|@ts-|go:|sourceMappingURL|!/|-\*-|shellcheck|coding[:=]|region|endregion)", re.I)
_LINE_MARK = re.compile(r"^[ \t]*(?:/\*+!?|//+[/!]?|\*+/?|#+!?|--+|;+)[ \t]?|\*+/[ \t]*$", re.M)


def fold(text: str) -> str:
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def _language(text: str) -> tuple[str, int] | None:
    """(language, words) of a text without code, or None if it isn't natural language or too short."""
    han = len(_HAN.findall(text))
    if han >= LEAST_HAN:
        return "zh", han
    plain = _NOISE.sub(" ", text)
    cyrillic = _CYRILLIC.findall(plain)
    if len(cyrillic) >= LEAST_WORDS:
        return "ru", len(cyrillic)
    tokens = _TOKEN.findall(plain)
    if len(tokens) < LEAST_WORDS:
        return None
    low = fold(" ".join(tokens))
    scores, held = dict.fromkeys(_LISTS, 0.0), 0
    for word in _PART.split(low):
        if used := _USED_BY.get(word):
            held += 1
            for lang in used:
                scores[lang] += 1 / len(used)
    if held < max(2, 0.18 * len(tokens)):
        return None
    # Code and lists have more marks than words.
    if len(re.findall(r"[{}\[\]();=<>$|\\^~*+]", plain)) > 0.35 * len(tokens) + 1:
        return None
    if not plain.isascii():
        raw = plain.lower()
        for lang, marks in _MARKS.items():
            scores[lang] += 0.5 * min(3, sum(map(raw.count, marks)))
    lang = max(scores, key=lambda k: (scores[k], k))
    words = _PART.split(low)
    # Another language's own words outweigh those that are the best language's alone.
    other = max(sum(w in own for w in words) for own in _RIVALS.values())
    if other >= 2 and other > sum(_USED_BY.get(w) == (lang,) for w in words):
        return None
    return (lang, len(tokens)) if scores[lang] >= 1 else None


def classify(span: str, kind: str) -> dict[str, float]:
    """The languages of a comment or literal, each with its part of the text: usually none or one; a run of line comments may hold several texts."""
    if kind == "string":
        body = span.strip("\"'`")
        if _SQL.match(body) or "\n" not in body and _DIRECTIVE.match(body):
            return {}
        if "\n" not in body:
            found = _language(body)
            return {found[0]: 1.0} if found else {}
        lines = body.split("\n")
    else:
        lines = _LINE_MARK.sub("", span).split("\n")
    # Runs of lines that aren't code.
    out: dict[str, int] = {}
    run: list[str] = []
    for line in [*lines, ""]:
        bare = line.strip()
        if bare and not _CODE_LINE.search(_NOISE_FREE.sub(" ", bare)) and not _DIRECTIVE.match(bare) and not _SQL.match(bare):
            run.append(bare)
            continue
        if run:
            for lang, size in _run_languages(run).items():
                out[lang] = out.get(lang, 0) + size
            run = []
    return {lang: size / sum(out.values()) for lang, size in out.items()}


_NOISE_FREE = re.compile(r"\b(?:https?|ftp)://\S+")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])")


def _run_languages(run: list[str]) -> dict[str, int]:
    """The languages of a run of lines, with the characters of each."""
    whole = _language(" ".join(run))
    if whole is None:
        return {}
    size = sum(map(len, run))
    if len(run) == 1 and not _SENTENCE.search(run[0]):
        return {whole[0]: size}
    # Texts in several languages may follow each other: sentences and lines of their own count where they are long enough.
    sizes = {whole[0]: size}
    pieces: list[str] = []
    for line in run:
        # A line that begins with a capital or mark begins a text, if the line before could end one.
        if pieces and not re.match(r"[A-ZÀ-ÞА-Я\W]", line):
            pieces[-1] += " " + line
        else:
            pieces.append(line)
    for piece in [s for p in pieces for s in _SENTENCE.split(p) if s]:
        found = _language(piece)
        if found and found[0] != whole[0]:
            own = min(len(piece), sizes[whole[0]] - 1)
            sizes[found[0]] = sizes.get(found[0], 0) + own
            sizes[whole[0]] -= own
    return sizes


def _worth(span: str, kind: str) -> bool:
    """Whether a span may hold a text: enough words or characters."""
    if len(span) < LEAST_HAN:
        return False
    if span.isascii():
        return span.count(" ") + span.count("\n") >= LEAST_WORDS - 1
    return len(span.split()) >= LEAST_WORDS or len(_HAN.findall(span)) >= LEAST_HAN


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    digest = xxhash.xxh3_128_digest
    known: set[bytes] = set()  # texts that this task has sent already
    for blocks in each_block(batches):
        rows = []
        for project, path, block, _, text in blocks:
            # The ending of a long file's later blocks is taken at its word.
            lang = language(path) if block else language_of(path, text)
            size = len(text.encode("utf-8", "replace")) if not text.isascii() else len(text)
            rows.append((project, path, block, CODE, None, None, size, None, None))
            for state in STATES[lang] if block else (CODE,):
                spans, leads_to = lex(text, lang, state)
                # The first block's map is needed only if it doesn't end in code.
                if block or leads_to != CODE:
                    rows.append((project, path, block, state, None, None, None, None, leads_to))
                counts: dict[bytes, list] = {}
                for kind, start, end in spans:
                    if kind != "regex" and _worth(span := text[start:end], kind):
                        key = digest(kind[0] + span)
                        held = counts.setdefault(key, [kind, 0, span])
                        held[1] += len(span.encode("utf-8", "replace"))
                for key, (kind, weight, span) in counts.items():
                    rows.append((project, path, block, state, key, kind, weight, None if key in known else span, None))
                    if len(known) < 200_000:
                        known.add(key)
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.string(), pa.string()]
        names = ["project", "path", "block", "state", "key", "kind", "bytes", "span", "leads_to"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, kinds, spans = (batch.column(k).to_pylist() for k in range(3))
        rows = [(key, lang, part) for key, kind, span in zip(keys, kinds, spans, strict=True) for lang, part in classify(span, kind).items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())], names=["key", "lang", "part"])


def code_languages(chunks: DataFrame) -> DataFrame:
    """project, path, lang, spans, bytes, share: natural language in each source file's comments and literals.

    spans counts distinct texts, bytes all their occurrences, share is bytes of the file's bytes; the bytes of a text in several
    languages are parted among them, so a file's shares are 1 together at most. Files of other endings, null
    contents and files without such text give no rows; repeated rows and overlapping windows count once; an empty table gives no
    rows. A comment or literal that crosses the end of a block of a very long file counts as two spans.
    """
    sources = chunks.where(F.col("path").rlike(r"(?i)\.(" + "|".join(ENDINGS) + ")$"))
    schema = "project string, path string, block int, state string, key binary, kind string, bytes bigint, span string, leads_to string"
    seen = cut(windows_by_block(sources).mapInArrow(_extract, schema))
    sizes = seen.where("key is null and leads_to is null").groupBy("project", "path").agg(F.sum("bytes").alias("size"), F.max("block").alias("last_block"))
    long = seen.where("leads_to is not null").select("project", "path", "block", "state", "leads_to")
    begun = entry_states(long)
    held = seen.where("key is not null")
    # Blocks after the first count in the state that the blocks before them lead to.
    later = held.where("block > 0").join(begun, ["project", "path", "block", "state"], "left_semi")
    uses = held.where("block = 0").unionByName(later).select("project", "path", "key", "bytes")
    texts = seen.where("span is not null").groupBy("key").agg(F.max("kind").alias("kind"), F.max("span").alias("span"))
    labels = texts.select("key", "kind", "span").mapInArrow(_classify, "key binary, lang string, part double")
    found = uses.join(labels, "key").groupBy("project", "path", "lang").agg(F.count_distinct("key").alias("spans"), F.round(F.sum(F.col("bytes") * F.col("part"))).cast("bigint").alias("bytes"))
    return found.join(sizes, ["project", "path"]).select("project", "path", "lang", "spans", "bytes", (F.col("bytes") / F.col("size")).alias("share"))
