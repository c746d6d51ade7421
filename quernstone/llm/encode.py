"""Token ids of whole texts by a public byte-level BPE (problem 8).

A text is cut into words by the tokenizer's pattern. Each distinct word is encoded once per worker (a bounded cache keeps
the recent ones). Within a word, a segment tree over byte positions stores the leftmost position of the least pair rank;
a merge is a point update of the pairs at the merged position and at its live left neighbour, so a word of n bytes costs
O(n log n) however long it is.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.session import spread

#: Where the tokenizers' files are, unless a caller gives another folder.
FOLDER = "/opt/tokenizers"
#: The word pattern that goes with the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words a worker remembers.
CACHE_WORDS = 200_000
NONE = 1 << 60


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks out of a .tiktoken file's content: a line holds a token in base64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, content.split(b"\n")))}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word. Raises KeyError if a byte has no rank of its own."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    n = len(word)
    size = 1 << max(1, (n - 1).bit_length())
    # tree[size + i]: rank of the pair that begins at byte i, times n, plus i, so that the least value is the leftmost least rank.
    tree = [NONE] * (2 * size)
    end = list(range(1, n + 1))  # where the live token that begins at i ends
    before = list(range(-1, n - 1))  # where the live token left of i begins
    for i in range(n - 1):
        if (rank := ranks.get(word[i : i + 2])) is not None:
            tree[size + i] = rank * n + i
    for node in range(size - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right

    def update(at: int, value: int) -> None:
        node = size + at
        tree[node] = value
        node >>= 1
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            least = left if left < right else right
            if tree[node] == least:
                return
            tree[node] = least
            node >>= 1

    while tree[1] < NONE:
        i = tree[1] % n
        j = end[i]  # the right token, which is merged into the left one
        stop = end[i] = end[j]
        update(j, NONE)
        if stop < n:
            before[stop] = i
            rank = ranks.get(word[i : end[stop]])
            update(i, NONE if rank is None else rank * n + i)
        else:
            update(i, NONE)
        if (h := before[i]) >= 0:
            rank = ranks.get(word[h:stop])
            update(h, NONE if rank is None else rank * n + h)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def make_encoder(content: bytes, pattern: str = PATTERN, cache_words: int = CACHE_WORDS) -> Callable[[str], list[int]]:
    """A function from text to ids. Text that looks like a special token is plain text."""
    import regex

    ranks = read_ranks(content)
    words = regex.compile(pattern).findall
    known = lru_cache(maxsize=cache_words)(lambda word: tuple(merge_word(word.encode("utf-8", "replace"), ranks)))

    def encode(text: str) -> list[int]:
        out: list[int] = []
        for word in words(text):
            out.extend(known(word))
        return out

    return encode


#: The encoders that this worker made, by their vocabulary.
_ENCODERS: dict[str, Callable[[str], list[int]]] = {}


def _encoder(key: str, content: bytes) -> Callable[[str], list[int]]:
    if key not in _ENCODERS:
        while len(_ENCODERS) > 3:
            del _ENCODERS[next(iter(_ENCODERS))]
        _ENCODERS[key] = make_encoder(content)
    return _ENCODERS[key]


def encode_texts(df: DataFrame, key: str | Column = "doc_id", text: str | Column = "text", tokenizer: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """doc_id, ids: the ids of each row's text, in one pass without a shuffle.

    The empty text gives an empty list and the null text a null; a null key and repeated rows are kept as they are; an
    empty table gives no rows; other columns, whatever their names, are ignored. A text is processed whole; its memory is
    in proportion to its length. The vocabulary is read by the driver and goes along with the job: a file of a fixed size.
    """
    with open(os.path.join(folder, f"{tokenizer}.tiktoken"), "rb") as file:
        content = file.read()
    vocabulary, held = sha256(content).hexdigest(), df.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary, held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [None if t is None else encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    key, text = (F.col(x) if isinstance(x, str) else x for x in (key, text))
    rows = spread(df.select(key.alias("doc_id"), text.cast("string").alias("text")))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")
