"""Passages of held-out items inside a corpus (problem 9).

One Aho-Corasick automaton over the normalised words of all items. Its patterns are runs of ANCHOR consecutive words, begun at so
many places of an item that every passage of the least length holds a whole one, as sequences of word numbers. A text is scanned
once, word by word; a hit is compared with its item word by word to both sides, and keeps the offsets of its words in the
original text. Items are held by every worker, so their size is checked: an item of more than PART_WORDS words is cut into
overlapping parts, parts beyond ITEM_BYTES together make several blocks, and the corpus is scanned once for each block.
"""

from __future__ import annotations

import html
import re
import unicodedata
from array import array
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.session import cut, spread

#: Consecutive words that make a passage, words of a pattern, words of an item's part, bytes of item text that one automaton may hold.
PASSAGE_WORDS, ANCHOR, PART_WORDS, ITEM_BYTES = 12, 6, 200_000, 4_000_000

# Characters without width of their own never part a word.
_INVISIBLE = "­​‌‍⁠﻿"
_WORD = re.compile(f"(?:[^\\W_]|[̀-ͯ{_INVISIBLE}])+")
_ASCII_WORD = re.compile("[a-z0-9]+")
_DROP = re.compile(f"[{_INVISIBLE}]")
# Numbers that a line may begin with, behind any marks, without being part of its text. Marks alone hold no word.
_PREFIX = re.compile(r"^[ \t>|#*+;%/(\[-]*\d{1,6}[ \t]*[.):|\]][ \t]+", re.M)
# A tag's attributes may be as long as they like; without any it ends on its line.
_TAG = re.compile(r"</?[A-Za-z][\w:.-]*+(?:\s++[\w:@.-]++(?:\s*+=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]++))?+)++\s*+/?>|</?[A-Za-z][^<>\n]*+>|<!--.*?-->", re.S)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]\w{1,30});")
_LINK = re.compile(r"\]\((?:[^()\s]|\([^()\s]*+\))++(?:[ \t]+(?:\"[^\"\n]*\"|'[^'\n]*'))?\)")


def fold_word(word: str) -> list[str]:
    """The plain forms of one run of letters and digits: no case, no accents; a compatibility form may hold several."""
    if word.isascii():
        return [word.lower()]
    plain = unicodedata.normalize("NFKD", _DROP.sub("", word).casefold())
    return [m.casefold() for m in re.findall(r"[^\W_]+", "".join(c for c in plain if not unicodedata.combining(c)))]


def words_of(text: str) -> Iterator[tuple[str, int, int]]:
    """(folded word, start, end in the text) of each word."""
    for m in _WORD.finditer(text):
        for w in fold_word(m.group()):
            yield w, m.start(), m.end()


def folded_words(text: str) -> list[str]:
    """The folded words alone, as words_of gives them."""
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    return [w for word in _WORD.findall(text) for w in fold_word(word)]


def plain_view(text: str) -> str | None:
    """The text with line prefixes, tags and entities blanked out at equal length, or None if it holds none.

    Equal length keeps offsets: an entity that stands for a letter is put at its first place.
    """
    blank = lambda m: " " * len(m.group())
    out = _PREFIX.sub(blank, text)
    if "<" in out:
        out = _TAG.sub(blank, out)
    if "&" in out:
        out = _ENTITY.sub(lambda m: html.unescape(m.group())[:1] + _INVISIBLE[1] * (len(m.group()) - 1), out)
    if "](" in out:
        out = _LINK.sub(blank, out)
    return out if out != text else None


class Scanner:
    """Finds the items of which a text holds a passage. items: (item, its folded words)."""

    def __init__(self, items: list[tuple[int, list[str]]], words: int = PASSAGE_WORDS):
        import ahocorasick

        self.words, self.number, self.items, self.parts = words, {}, [], []
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        # A run of ``words`` words holds a pattern of ``size`` words that begins at a multiple of ``step``.
        self.size = min(ANCHOR, words)
        step = words - self.size + 1
        for item, own in items:
            numbers = array("i", [self.number.setdefault(w, len(self.number) + 1) for w in own])
            if len(numbers) < words:
                continue
            self.items.append(item)
            self.parts.append(numbers)
            for at in range(0, len(numbers) - self.size + 1, step):
                run = tuple(numbers[at : at + self.size])
                if run in self.automaton:
                    self.automaton.get(run).append((len(self.parts) - 1, at))
                else:
                    self.automaton.add_word(run, [(len(self.parts) - 1, at)])
        self.empty = len(self.automaton) == 0
        self.automaton.make_automaton()

    def passages(self, text: str) -> dict[int, tuple[int, int, int]]:
        """item: (start, end, words) of its longest passage in the text, the first of equally long ones."""
        found: dict[int, tuple[int, int, int]] = {}
        if self.empty:
            return found
        for view in (text, plain_view(text)):
            if view is None:
                continue
            number = self.number.get
            ids = tuple([number(w, 0) for w in folded_words(view)])
            hits = self.automaton.iter(ids) if len(ids) >= self.words else ()
            spans: list[tuple[int, int]] | None = None
            seen: dict[tuple[int, int], int] = {}  # how far a part was compared, by its shift against the text
            for last, places in hits:
                for part, at in places:
                    first = last - self.size + 1
                    if seen.get((part, first - at), -1) >= last:
                        continue
                    own = self.parts[part]
                    low, high = 0, self.size
                    while first + low > 0 and at + low > 0 and ids[first + low - 1] == own[at + low - 1]:
                        low -= 1
                    while first + high < len(ids) and at + high < len(own) and ids[first + high] == own[at + high]:
                        high += 1
                    seen[part, first - at] = first + high - 1
                    if high - low < self.words:
                        continue
                    spans = spans if spans is not None else [(start, end) for _, start, end in words_of(view)]
                    passage = (spans[first + low][0], spans[first + high - 1][1], high - low)
                    item = self.items[part]
                    if item not in found or (-passage[2], passage[0]) < (-found[item][2], found[item][0]):
                        found[item] = passage
        return found


#: The scanners that this worker made last, by what they were made of.
_SCANNERS: dict[str, Scanner] = {}


def _scanner(key: str, items: list[tuple[int, str]], words: int) -> Scanner:
    if key not in _SCANNERS:
        while len(_SCANNERS) > 1:
            del _SCANNERS[next(iter(_SCANNERS))]
        _SCANNERS[key] = Scanner([(item, text.split(" ")) for item, text in items], words)
    return _SCANNERS[key]


def _parts(words: int):
    """For mapInArrow over items: (item_id, folded words of a part); parts overlap so that no passage is parted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = folded_words(text)
                out += [(item, " ".join(own[at : at + PART_WORDS])) for at in range(0, max(1, len(own) - words + 1), PART_WORDS - words + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string())], names=["item_id", "words"])

    return run


def leaked_passages(documents: DataFrame, items: DataFrame, words: int = PASSAGE_WORDS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """doc_id, item_id, passage_start, passage_end, passage_words: a row for each document and item of which it holds a passage.

    Offsets count characters of the original text from 0, the end is past the last; of an item in several parts, the passage is
    the longest within a part. Null, empty and blank texts, and items of fewer words than a passage, match nothing; an item given
    twice counts once; copied documents count each; a repeated document row gives one row. An empty corpus or item table gives
    no rows. Other columns are ignored.
    """
    own = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(_parts(words), "item_id bigint, words string")
    own = cut(own.groupBy("item_id", "words").agg(F.lit(1).alias("one")).select("item_id", "words"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0)).alias("b")).first()["b"]
    blocks = -(-int(size) * 2 // item_bytes) if size > item_bytes else 1
    texts = spread(documents.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null"))
    schema = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, item_id bigint, passage_start int, passage_end int, passage_words int"
    out = None
    for block in range(blocks):
        part = own if blocks == 1 else own.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == block)
        rows = sorted((int(r["item_id"]), r["words"]) for r in part.toLocalIterator())
        key = sha256(repr((words, rows)).encode("utf-8", "replace")).hexdigest()
        held = documents.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], held=held, key=key) -> Iterator[pa.RecordBatch]:
            scanner = _scanner(key, held.value, words)
            for batch in batches:
                ids, rows = batch.column(0).to_pylist(), []
                for doc, text in zip(ids, batch.column(1).to_pylist(), strict=True):
                    rows.extend((doc, item, *p) for item, p in scanner.passages(text).items())
                names = ["doc_id", "item_id", "passage_start", "passage_end", "passage_words"]
                kinds = [batch.schema.field(0).type, pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

        found = texts.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    # Of an item in several parts or blocks the longest passage, the first of equally long ones.
    best = F.struct("passage_words", (-F.col("passage_start")).alias("s"), (-F.col("passage_end")).alias("e"))
    return out.groupBy("doc_id", "item_id").agg(F.max(best).alias("p")).select("doc_id", "item_id", (-F.col("p.s")).alias("passage_start"), (-F.col("p.e")).alias("passage_end"), F.col("p.passage_words").alias("passage_words"))
