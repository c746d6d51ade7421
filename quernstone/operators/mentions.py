"""Where texts hold names of which a project may have any number: no pair of a name and a text is made, and no text is shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.session import cut

#: Bytes of a text looked at together, words of 64 marks at most (16 MB go along with the job), words for each word that is set, the longest head.
STEP, MOST_WORDS, ROOM, HEAD = 1 << 16, 1 << 21, 16, 64
_BASE, _MIX, _SALT = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


def _head(length: int) -> int:
    """Bytes of a name's head: the largest power of two that it has room for, up to HEAD."""
    return min(HEAD, 1 << length.bit_length() - 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2 to the 64th."""
    return tuple(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, x, np.uint64).cumprod(dtype=np.uint64))) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


def _sums(octets: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Sums s, so that (s[i + n] - s[i]) * inverse[i] is the same for equal n bytes, wherever they stand."""
    out = np.zeros(len(octets) + 1, np.uint64)
    np.cumsum((octets.astype(np.uint64) + np.uint64(1)) * powers[: len(octets)], out=out[1:])
    return out


def _mixed(x: np.ndarray, salt) -> np.ndarray:
    x = x + salt
    return (x ^ (x >> np.uint64(29))) * np.uint64(_MIX)


def _salt(length: int, head: bool) -> np.uint64:
    return np.uint64((2 * length + head) * _SALT % (1 << 64))


def _places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word and the bit in it that stand for a value."""
    return (x >> np.uint64(43)).astype(np.int64), (x >> np.uint64(37)) & np.uint64(63)


def _octets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and where each row begins and the last ends."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)), at - at[0]


def _mark(batches):
    """For mapInArrow over (seed, name): the words and bits of each name and of its head, and minus its length as a word without bits."""
    for batch in batches:
        if not len(batch):
            continue
        octets, at = _octets(batch.column("key"))
        powers, inverse = _powers(len(octets) + 1)
        sums, begin, length = _sums(octets, powers), at[:-1], np.diff(at)
        seed = np.asarray(batch.column("seed")).view(np.uint64)
        words, bits = [], []
        for n in np.unique(length):
            own, head = length == n, _head(int(n))
            i = begin[own]
            for x in (_mixed((sums[i + head] - sums[i]) * inverse[i], _salt(head, True)), _mixed((sums[i + n] - sums[i]) * inverse[i], seed[own] + _salt(int(n), False))):
                w, b = _places(x)
                words.append(w)
                bits.append(np.uint64(1) << b)
            words.append(np.array([-n]))
            bits.append(np.zeros(1, np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(words)), pa.array(np.concatenate(bits).view(np.int64))], ["word", "bits"])


def _held(marks):
    """For mapInArrow over (project, path, start_line, end_line, seed, content): each text's parts that may be names, once per text."""

    def held(batches):
        table, lengths = marks.value
        fold, most = np.int64(len(table) - 1), max(lengths)
        powers, inverse = _powers(STEP + most)
        heads = {}
        for n in lengths:
            heads.setdefault(_head(n), []).append(n)

        def marked(x):
            word, bit = _places(x)
            return np.flatnonzero((table[word & fold] >> bit) & np.uint64(1))

        for batch in batches:
            if not len(batch):
                continue
            octets, at = _octets(batch.column("content"))
            seed = np.asarray(batch.column("seed")).view(np.uint64)
            rows, keys = [], []
            seen = set()
            for low in range(0, len(octets), STEP):
                part = octets[low : low + STEP + most - 1]
                sums = _sums(part, powers)
                for head, own in heads.items():
                    m = min(STEP, len(part) - head + 1)
                    if m <= 0:
                        continue
                    place = marked(_mixed((sums[head : head + m] - sums[:m]) * inverse[:m], _salt(head, True)))
                    row = np.searchsorted(at, place + low, "right") - 1
                    room = at[row + 1] - place - low
                    for n in own:
                        fits = room >= n
                        i, r = place[fits], row[fits]
                        x = _mixed((sums[i + n] - sums[i]) * inverse[i], seed[r] + _salt(n, False))
                        k = marked(x)
                        for one in zip(r[k].tolist(), i[k].tolist()):
                            key = part[one[1] : one[1] + n].tobytes()
                            if (one[0], key) not in seen:
                                seen.add((one[0], key))
                                rows.append(one[0])
                                keys.append(key)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows, pa.int64())) for c in ("project", "path", "start_line", "end_line")), pa.array(keys, pa.binary())], ["project", "path", "start_line", "end_line", "key"])

    return held


def all_mentions(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """project, path, name, first_line, last_line: the files in whose texts each name of their project occurs, in any case, within words too.

    Rolling hashes of a text's bytes are looked up in marks of all names, those of a head first and then those of each length that
    names have; what is marked is joined to the names, so that wrong marks cost time but change nothing. The marks have a fixed
    size at most, whatever the number of names. chunks are filtered by the caller; repeated rows change nothing. Null or empty names
    and rows with a null project or content give nothing; without names there are no rows.
    """
    own = cut(names.where("project is not null and name <> ''").select("project", F.lower("name").alias("name")).distinct().withColumn("key", F.col("name").cast("binary")))
    found = own.select(F.xxhash64("project").alias("seed"), "key").mapInArrow(_mark, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    word, bits = (np.asarray(found.column(c).combine_chunks()) for c in ("word", "bits"))
    lengths, word, bits = sorted((-word[word < 0]).tolist()), word[word >= 0], bits[word >= 0].view(np.uint64)
    table = np.zeros(min(MOST_WORDS, 1 << (ROOM * len(word)).bit_length()), np.uint64)
    np.bitwise_or.at(table, word & (len(table) - 1), bits)
    texts = chunks.where("project is not null and content is not null").select("project", "path", "start_line", "end_line", F.xxhash64("project").alias("seed"), F.lower("content").cast("binary").alias("content"))
    if not lengths:
        texts, lengths = texts.limit(0), [1]
    held = texts.mapInArrow(_held(chunks.sparkSession.sparkContext.broadcast((table, lengths))), "project string, path string, start_line int, end_line int, key binary")
    return held.join(own, ["project", "key"]).groupBy("project", "path", "name").agg(F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"))
