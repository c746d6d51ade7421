"""Template residue, filler, error pages and scripts-required notices (problem 10).

Trusted labels come from what a text holds: an unfilled placeholder in running text, or a text that, without its page frame
and title, consists of nothing but filler, form prompts, error or refusal lines, or a notice that scripts must be allowed.
Partitioned SimHash tables over five-word shingles then find near-duplicates of labelled texts; a candidate has to agree in
Hamming distance and in shingle similarity, and labels spread through the connected components that such links make. Keys grow
with the logarithm of the number of texts, and tables with them, so that slots stay as full as they are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.session import cut, spread

#: Words of a shingle, least similarity of near-duplicates, SimHash bits.
SHINGLE, SIMILARITY, BITS = 5, 0.8, 256
#: Bits in which signatures of near-duplicates may differ: an angle of 0.476 (Jaccard 0.8) gives 39 of 256, plus four deviations.
HAMMING, EXPECTED = 62, 39
#: Chance that two texts of just the least similarity meet in some table, and the fewest bits of a table's key.
MEET, LEAST_KEY_BITS = 0.9, 16

_FENCE = re.compile(r"^[ \t]*(```|~~~)[^\n]*\n.*?(?:^[ \t]*\1[ \t]*$|\Z)", re.S | re.M)
_TICKS = re.compile(r"(`+)[^`\n]+?\1")
# Fixed forms of an unfilled placeholder.
_PLACEHOLDER = re.compile(
    r"(?=[{<$#\[%_@«])(?:"
    + "|".join(
        (
            r"\{\{[^{}\n]{1,80}\}\}",
            r"\{%[^%\n]{1,80}%\}",
            r"<%=?[^%\n]{1,80}%>",
            r"\$\{[^{}\n]{1,80}\}",
            r"\$\([A-Za-z_][\w .-]{0,60}\)",
            r"#\{[^{}\n]{1,80}\}",
            r"\[\[[^\[\]\n]{1,80}\]\]",
            r"(?<![\w<])<[A-Z][A-Z0-9]*(?:[ _-][A-Z0-9]+)+>",
            r"<(?i:insert|your|enter|add|put)\b[^<>\n]{1,80}>",
            r"\[(?i:insert|todo|your|enter|tbd|fill in)\b[^\[\]\n]{1,80}\](?!\()",
            r"(?<![\w%])%[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*%(?![\w%])",
            r"%\([a-z_]\w*\)[sd]",
            r"(?<!\w)__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__(?!\w)",
            r"@@\w+@@",
            r"##[A-Z][A-Z0-9_]*##",
            r"(?<![\w\\{$])\{(?:[A-Za-z]\w*|\d)\}(?!\})",
            r"«\w+ (?:del|de la|de|of the|of|du|da|do|der|des) \w+»",
        )
    )
    + ")"
)
# Fields in brackets, as letters have them.
_GREETED = re.compile(r"\b(?:dear|hello|hi|hola|estimad[oa]|liebe[r]?|bonjour|prezad[oa])\s+\[[A-Z][\w .'-]{1,40}\](?!\()", re.I)
_FIELD = re.compile(r"\[((?:your|company|customer|client|recipient|sender|order|invoice|first|last|full|product|start|end|due|phone|e-?mail|street|city|address|date|name|amount|signature|job|position)(?: (?:name|number|date|address|title|id|code|amount|company|here))?)\](?![(\[])", re.I)
_HTML = re.compile(r"</?(?:html|head|title|body|center|h\d|hr|p|br|div|span|noscript|meta|strong|em|b|i|a|ul|li|pre)\b[^<>]*>|<!doctype[^<>]*>", re.I)
# What page frames are made of.
_FRAME = re.compile(r"(?:home|docs|documentation|search|sign in|sign out|log in|login|contact|changelog|projects|status|terms|privacy|imprint|about|help|blog|menu|language: ?\w+|back to top|skip to content|build \d+|©.*|inicio|buscar|contacto|impressum|datenschutz|accueil|recherche)", re.I)
_FRAME_SEP = re.compile(r"\s*[|/·>•»]\s*")


def _any(patterns: tuple[str, ...]) -> re.Pattern:
    """One pattern that fits what any of the patterns fits."""
    return re.compile("|".join(f"(?:{p})" for p in patterns), re.I)


_STATUS = (
    r"(?:bad request|unauthori[sz]ed|forbidden|(?:page )?not found|gone|request time-?out|too many requests|internal server error|internal error|"
    r"not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|access denied|permission denied)"
)
# Lines that such a page is made of: those that it begins, then those that stand somewhere in it.
_STRONG_BEGIN = _any(
    (
        # Status lines, in whatever order their parts stand.
        rf"^(?:https?(?:/\d(?:\.\d)?| status)?[ :]*)?(?:error[ :]*)?[45]\d\d\s*[-|:–—]*\s*{_STATUS}\W*(?:\W+[45]\d\d\s+{_STATUS})?(?:\W+\w+)?\W*$",
        rf"^(?:error\s*[:-]?\s*)?{_STATUS}\s*\(?(?:error )?[45]\d\d\)?\W*$",
        r"^[45]\d\d\W*$",
        rf"^{_STATUS}\W*$",
        r"^(?:error|erreur|fehler|erro|errore|ошибка|错误)\s*[45]\d\d\s*[:–-].{0,90}$",
        r"^(?:the )?requested url \S+ was not found on this server\b",
        r"^the page you (?:asked for|requested|are looking for)\b.{0,60}(?:isn't here|not found|doesn't exist|does not exist|moved)",
        r"^you (?:don't|do not) have permission to (?:open|access|view)\b.{0,80}$",
        r"^oops\b.{0,60}(?:wrong|error|broke)",
        r"^(?:sorry, )?we (?:couldn't|could not|can't|cannot) find (?:a|an|the|that|this|what)\b.{0,60}$",
        r"^upstream connect error\b",
        r"^something went wrong\b.{0,60}$",
        r"^too many requests\b",
        r"^access (?:is |was )?denied\W*$",
        r"^your (?:address|ip|account) has been blocked\b",
        r"^your session (?:has )?(?:expired|ended|timed out)\b",
        r"^this (?:repository|page|project|site) is (?:empty or|private|not available|temporarily)\b.{0,80}$",
        r"^(?:p[áa]gina no (?:disponible|encontrada)|p[áa]gina n[ãa]o encontrada|seite nicht gefunden|page (?:introuvable|non trouv[ée]e)|страница не найдена|页面不存在|找不到页面)\W*$",
        r"^el servidor est[áa] en mantenimiento\b",
        # Scripts must be allowed.
        r"^(?=.{0,160}\b(?:java ?script|js|(?:client-side )?scripts?|scripting)\b)(?=.{0,160}\b(?:please|sorry|must|have to|need(?:s)? to|requires?|required|before you go on|to (?:open|view|use|see|continue))\b)" r".{0,120}\b(?:enable|activate|allow|switch on|turn on|turned on|requires?|needs?)\b.{0,120}$",
        r"^(?:bitte|s'il vous pla[iî]t|veuillez|por favor|para usar|para ver|ative|activez|activa|active|habilite|cette application|esta (?:p[áa]gina|aplicaci[óo]n|app)|diese seite|пожалуйста|для|включите|请).{0,90}\bjava ?script\b.{0,90}$",
        # Filler and prompts of an untouched form.
        r"^(?:tbd|tba|to be (?:completed|done|written|added)|coming soon|write something here|lorem ipsum\b.*|under construction|n/?a|por completar|próximamente|folgt)\W*$",
        r"^(?:(?:your (?:description|text|content|title|heading|name) goes here|(?:heading|title|text) goes here|placeholder (?:copy|text)[^.]*|sample text[^.]*|replace this (?:paragraph|text|line)[^.]*|hier steht später[^.]*|aquí va el[^.]*|insert (?:your )?text here|ici viendra[^.]*|aqui vai[^.]*)(?:\W+|$))+$",
        r"^\((?:say|describe|add|write|tell|explain|list|paste)\b[^()]*\)$",
        r"^<!--.*-->$",
        r"^\[e\.? ?g\.[^\]]*\]$",
        r"^- \[ \] ",
        r"^\d\. (?:go to|click on|scroll down to) '\.+'$",
        r"^\d\. see (?:the )?error$",
        # What servers, frameworks and hosts answer of their own.
        r"^http (?:status|error) [45]\d\d\b.{0,90}$",
        r"^error establishing a database connection\W*$",
        r"^whitelabel error page\W*$",
        r"^this application has no explicit mapping for /error\b",
        r"^there has been a critical error on (?:this|your) (?:web ?)?site\b",
        r"^the origin server did not find a current representation\b",
        r"^the (?:web ?)?server (?:is temporarily unable to service|encountered an internal error|can(?:not|'t) process the request)\b",
        r"^the requested (?:resource|page|url|document|file) (?:\S+ )?(?:could not be found|cannot be found|was not found|is not available|does not exist)\b",
        r"^(?:this site|this page|the connection) (?:can[’']t|can ?not) be (?:reached|established)\b",
        r"^\S+ refused to connect\W*$",
        r"^(?:sorry, )?you have been blocked\W*$",
        r"^just a moment\W*$",
        r"^(?:php )?(?:parse|fatal) error: .{0,160} on line \d+\W*$",
        r"^please turn (?:on java ?script|java ?script on)\b.{0,80}$",
    )
)
_STRONG_WITHIN = _any(
    (
        r"\b(?:down|closed|offline|unavailable) for (?:\w+ )?(?:upkeep|maintenance)\b.{0,60}$",
        r"\b(?:java ?script|scripts?) (?:is|are|seems? to be) (?:disabled|off|blocked|switched off|turned off)\b.{0,100}$",
        r"\b(?:doesn't|does not|won't|cannot|can't) work (?:properly )?without (?:java ?script|scripts?)\b",
        r"\b(?:blocks|needs|requires) (?:java ?script|scripts)\b.{0,40}$",
        r"\bjava ?script\b.{0,60}(?:aktivieren|eingeschaltet|activ[ea]r?|activer|habilitar|ativar|включ\w+|启用|开启)\b.{0,40}$",
        r"(?:启用|开启|打开|включите).{0,20}java ?script",
        r"\b(?:doesn't|does not) support java ?script\b.{0,60}$",
    )
)
_ALSO = _any(
    (
        r"^(?:please )?(?:try|load|check|wait|go|return|turn|sign|slow|contact|use|write|compruebe|vuelva|int[ée]ntelo|merci|veuillez|bitte versuchen|tente)\b.{0,110}$",
        r"^(?:request|error|trace|reference|ray|incident|event|código|code)(?: ?(?:id|no))?\W{0,3}[#:]?\s*[\w-]{4,40}\W*$",
        r"^(?:[\w-]+ ){0,2}[\w-]+/\d+(?:\.\d+)*\W*$",
        r"^served by \S+$",
        r"^[\w-]+ port \d+\W*$",
        r"^the address \S+ (?:does not|doesn't) exist\W*$",
        r"^the \w+ you want (?:can't|cannot) be shown\b.{0,40}$",
        r"^(?:if this goes on|if the problem|it may have been|you've gone over|you have gone over|our team|we were told|the team|our side|this takes|loading|checking your browser|without (?:it|them|scripts)|nothing can be|sorry|type: |message: |status: |description: )",
        r"^(?:el|la|le|der|die|das|o|a) \w+ (?:está|est|ist) .{0,60}$",
        r"^[\w.-]{2,30}$",
    )
)
_HEADING = re.compile(r"^#{1,6}\s")
_LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
# Words that are typed where a text is missing.
_JUNK = frozenset("aaa abc asdf bar baz bbb bla blah ccc content dummy foo hjkl jkl qux qwer qwerty row test testing text xxx xyz yyy zzz".split())
_WORD = re.compile(r"\w+")
_UNIT = re.compile(r"(?<=[^\d\s][.!?])\s+(?=\S)|(?<=[。！？])")


def without_code(text: str) -> str:
    """The running text: fenced blocks and code in backticks are blanked out."""
    return _TICKS.sub(" ", _FENCE.sub("\n", text)) if "`" in text or "~~~" in text else text


def _is_frame(line: str, near: bool) -> bool:
    parts = [p for p in _FRAME_SEP.split(line.strip()) if p]
    if not parts or len(line) > 200:
        return False
    if any(_FRAME.fullmatch(p) for p in parts):
        return all(len(p.split()) <= 3 for p in parts)
    return near and len(parts) == 1 and bool(re.fullmatch(r"[^\W\d_]{2,20}", line.strip()))


def strip_frame(text: str) -> str:
    """The text without the lines of a page frame at its top and bottom."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").strip().split("\n")
    # A lone word counts as part of a frame only if it stands among lines that are.
    for _ in range(2):
        at, near = 0, False
        while at < len(lines) and (not lines[at].strip() or _is_frame(lines[at], near or (at + 1 < len(lines) and _is_frame(lines[at + 1], False)))):
            near = near or bool(lines[at].strip())
            at += 1
        lines = lines[at:][::-1]
    return "\n".join(lines).strip()


def _repeats(words: list[str]) -> bool:
    """Few words over and over, as no text has them."""
    distinct = set(words)
    return len(words) >= 6 and (len(distinct) <= max(2, min(14, len(words) // 4)) or sum(w in _JUNK for w in words) >= 0.85 * len(words))


def _is_strong(unit: str) -> bool:
    return bool(_STRONG_BEGIN.match(unit) or _STRONG_WITHIN.search(unit))


def _is_letter(text: str) -> bool:
    """Whether a text greets a field in brackets, or has two different ones for what a letter or form is filled with."""
    return bool(_GREETED.search(text)) or len({m.lower() for m in _FIELD.findall(text)}) >= 2


def label(text: str, core: str | None = None) -> str | None:
    """The kind of residue that a text is or holds, or None. core: the text without its frame, if it is known."""
    if not text or not text.strip():
        return None
    if _PLACEHOLDER.search(text) and _PLACEHOLDER.search(without_code(text)) or "[" in text and _is_letter(without_code(text)):
        return "placeholder"
    core = strip_frame(text) if core is None else core
    if not core:
        return None
    plain = core
    if "<" in plain:
        plain = re.sub(r"\n\s*", "\n", _HTML.sub("\n", plain)).strip()
    body = "\n".join(x for x in plain.split("\n") if not _HEADING.match(x))
    for part in (body, "\n".join(plain.split("\n")[1:])):
        own = _WORD.findall(part.lower())
        if len(own) >= 6 and sum(w in _LOREM for w in own) >= 0.85 * len(own) and len(set(own) & _LOREM) >= 5:
            return "filler"
        if own and _repeats(own) and "|" not in part and not re.search(r"[{};=`]", part):
            return "filler"
    strong, lines = 0, [x.strip() for x in plain.split("\n") if x.strip()]
    for k, line in enumerate(lines):
        bare = line.lstrip("# ") if (heading := bool(_HEADING.match(line))) else line
        if _is_strong(bare):
            strong += 1
            continue
        for unit in _UNIT.split(bare):
            if not unit or not unit.strip():
                continue
            if unit != bare and _is_strong(unit.strip()):
                strong += 1
            elif heading or _ALSO.match(unit.strip()):
                continue
            elif k == 0 and len(lines) > 1 and unit == bare and len(unit) <= 80 and not re.search(r"[.!?:;]$", unit):
                continue  # a title
            else:
                return None
    return "page" if strong else None


def shingle_hashes(words: list[str]) -> list[int]:
    """The distinct 64-bit hashes of the runs of SHINGLE words; a shorter text is one run."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return list({h(" ".join(words[i : i + SHINGLE])) for i in range(max(1, len(words) - SHINGLE + 1))}) if words else []


def signatures(texts: list[list[int]]):
    """SimHash of each text's shingle hashes: for each bit, whether most of the shingles' bits are set. One pass over all shingles."""
    import numpy as np

    out = np.zeros((len(texts), BITS), dtype=np.uint8)
    at = 0
    while at < len(texts):
        # As many texts at a time as have about 32,000 shingles together; a longer text is one part of its own.
        stop, n = at, 0
        while stop < len(texts) and (n == 0 or n + len(texts[stop]) <= 32_768):
            n += len(texts[stop])
            stop += 1
        sizes = np.array([len(t) for t in texts[at:stop]], dtype=np.int64)
        h = np.fromiter((x for t in texts[at:stop] for x in t), dtype=np.uint64, count=n)
        counts = np.zeros((stop - at, BITS), dtype=np.int64)
        for low in range(0, n, 65_536):
            part = h[low : low + 65_536]
            # Only a text of its own is longer than a part, so a part's texts begin where their sizes say.
            begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if stop - at > 1 else np.zeros(1, dtype=np.int64)
            for k in range(BITS // 64):
                mixed = part ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF)
                mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                mixed ^= mixed >> np.uint64(31)
                bits = np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1)
                counts[:, k * 64 : (k + 1) * 64] += np.add.reduceat(bits, begins, axis=0, dtype=np.int32)
        out[at:stop] = 2 * counts > sizes[:, None]
        at = stop
    return out


def key_bits(texts: int) -> int:
    """Bits of a table's key, growing with the number of texts, so that a slot holds about as many of them at any size."""
    return max(LEAST_KEY_BITS, math.ceil(math.log2(max(1, texts))) - 4)


def tables_for(bits: int, meet: float = MEET) -> int:
    """Tables so that two texts of just the least similarity share a key in some table with chance ``meet``."""
    share = (1 - EXPECTED / BITS) ** bits
    return math.ceil(math.log(1 - meet) / math.log(1 - share))


def _tables(bits: int):
    """Which bits of a signature each table's key is made of: the bits in fixed shuffles, cut into keys."""
    import numpy as np

    tables = tables_for(bits)
    orders = [np.random.default_rng(seed).permutation(BITS) for seed in range(-(-tables * bits // BITS))]
    return np.concatenate(orders)[: tables * bits].reshape(tables, bits)


_DIGITS = re.compile(r"\w*\d\w*")


def masked_words(core: str) -> list[str]:
    """The words of a text with whatever holds a digit as 0, so that numbers, dates and ids don't tell texts of one form apart."""
    return _WORD.findall(_DIGITS.sub("0", core.lower()))


def _describe(bits: int):
    """For mapInArrow over (doc_id, text): kind, class, number of shingles, signature and table keys of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        tables, weights = _tables(bits), 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "kind", "core", "shingles", "bits", "keys")}
            held = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                core = strip_frame(text)
                words = masked_words(core)
                if not words:
                    continue
                held.append(shingle_hashes(words))
                out["doc_id"].append(doc)
                out["kind"].append(label(text, core))
                out["core"].append(xxhash.xxh3_128_digest(" ".join(words)))
                out["shingles"].append(len(held[-1]))
            if held:
                signed = signatures(held)
                out["bits"] = np.packbits(signed, axis=1).view(">i8").astype(np.int64).tolist()
                out["keys"] = (signed[:, tables].astype(np.int64) @ weights).tolist()
            kinds = [batch.schema.field(0).type, pa.string(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(out.values(), kinds, strict=True)], names=list(out))

    return run


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = [[h - (1 << 63) for h in shingle_hashes(masked_words(strip_frame(t)))] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.list_(pa.int64()))], names=["core", "hashes"])


def find_residue(documents: DataFrame) -> DataFrame:
    """doc_id, kind, spread: the documents to leave out. kind: 'placeholder', 'filler', 'page'; spread: the label came by likeness.

    Null, empty and blank texts are no residue; copies count each; a repeated row gives one row. Placeholder labels do not
    spread, since a text with the value filled in is a good near-duplicate. A text in which several rules hold takes the
    first kind in the order given. An empty table gives no rows; other columns are ignored.
    """
    texts = spread(documents.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null and length(trim(text)) > 0"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    seen = cut(texts.mapInArrow(_describe(key_bits(documents.count())), f"doc_id {kind}, kind string, core binary, shingles int, bits array<bigint>, keys array<bigint>"))
    # One representative per text but for its numbers, so that copies and fillings of one form make no pairs.
    spreads = F.when(F.col("kind") != "placeholder", F.col("kind"))
    classes = cut(seen.groupBy("core").agg(F.max(spreads).alias("kind"), F.min("doc_id").alias("doc_id"), F.first("shingles").alias("shingles"), F.first("bits").alias("bits"), F.first("keys").alias("keys")))
    labelled = classes.where("kind is not null").select("core", "kind")
    # Texts that are alike have about as many shingles: a slot of a table holds a key and a step of that number, and the steps beside it are tried too.
    step = F.floor(F.log(F.col("shingles").cast("double")) / F.log(F.lit(1.0 / SIMILARITY))).cast("int")
    slot = F.xxhash64("table", "key", "step").alias("slot")
    entries = classes.where("kind is null").select("core", step.alias("step"), F.posexplode("keys").alias("table", "key")).select("core", slot)
    signatures = classes.select("core", "bits")
    frontier = labelled
    while True:
        probes = frontier.join(classes.select("core", "shingles", "keys"), "core").select(F.col("core").alias("near"), "kind", step.alias("mid"), F.posexplode("keys").alias("table", "key"))
        probes = probes.withColumn("step", F.explode(F.array(F.col("mid") - 1, F.col("mid"), F.col("mid") + 1))).select("near", "kind", slot)
        pairs = entries.join(probes, "slot").groupBy("core", "near").agg(F.max("kind").alias("kind")).join(labelled.select("core"), "core", "left_anti")
        both = pairs.join(signatures, "core").join(signatures.select(F.col("core").alias("near"), F.col("bits").alias("near_bits")), "near")
        hamming = reduce(lambda a, b: a + b, [F.bit_count(F.col("bits")[k].bitwiseXOR(F.col("near_bits")[k])) for k in range(BITS // 64)])
        close = cut(both.where(hamming <= HAMMING).select("core", "near", "kind"))
        if close.isEmpty():
            break
        # Shingles only of the texts that came so far.
        wanted = close.select("core").union(close.select("near")).distinct().join(classes.select("core", "doc_id"), "core")
        hashes = cut(texts.join(wanted, "doc_id").groupBy("core").agg(F.max("text").alias("text")).mapInArrow(_shingles, "core binary, hashes array<bigint>"))
        shared = F.size(F.array_intersect("hashes", "near_hashes"))
        alike = shared >= SIMILARITY * (F.size("hashes") + F.size("near_hashes") - shared)
        checked = close.join(hashes, "core").join(hashes.select(F.col("core").alias("near"), F.col("hashes").alias("near_hashes")), "near").where(alike)
        frontier = cut(checked.groupBy("core").agg(F.max("kind").alias("kind")))
        if frontier.isEmpty():
            break
        labelled = cut(labelled.unionByName(frontier))
    own = seen.where("kind is not null").select("doc_id", "kind", F.lit(False).alias("spread"))
    # A copy in other case, spacing or numbers has its class's label, as every text that a label reached.
    reached = seen.where("kind is null").select("doc_id", "core").join(labelled, "core").select("doc_id", "kind", F.lit(True).alias("spread"))
    rank = F.when(F.col("kind") == "placeholder", 0).when(F.col("kind") == "filler", 1).otherwise(2)
    return own.unionByName(reached).groupBy("doc_id").agg(F.min_by("kind", rank).alias("kind"), F.min("spread").alias("spread"))
