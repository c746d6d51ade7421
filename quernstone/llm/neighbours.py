"""The most similar vectors of every vector, by collision-counting hashing (problem 2).

Every vector is projected on ``PROJECTIONS`` random lines of its model. Two vectors collide on a line if their places differ by
at most a window's half-width; windows are centred on the query and widened level by level (virtual rehashing) until the query
has enough vectors whose collisions exceed a threshold, or the widest distance of interest is reached. Only those vectors are
verified by their exact cosine.

On its own, counting compares every query with the fixed part of all vectors that shares its windows, which is quadratic. So
signs on further lines first cut each model's vectors into cells of bounded expected size, in as many independent tables as the
wanted recall needs, and sorted arrays with query-centred windows are built within each cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.session import cut

#: Lines for counting, half-width of a window per unit of distance, and collisions that make a candidate.
PROJECTIONS, WIDTH, COLLISIONS = 32, 1.6, 23
#: Parts of the widest distance at which windows stop on their way, and candidates with which a query stops widening.
LEVELS, ENOUGH = (0.35, 0.65, 1.0), 50
#: Vectors of a cell, as expected; a cell beyond CELL_MOST is cut into blocks of which every pair is compared.
CELL, CELL_MOST = 512, 4096
#: Chance that two vectors of the least similarity meet in some table.
RECALL = 0.995


def clean_vectors(embeddings: DataFrame) -> DataFrame:
    """chunk_id, model, dimension, vector: one usable vector per chunk, model and dimension, the latest delivered.

    Null, zero, infinite or NaN-bearing vectors, vectors whose length isn't dimension, and rows without chunk_id or model don't take part.
    """
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    rows = embeddings.where("chunk_id is not null and model is not null and vector is not null and size(vector) = dimension and dimension > 0").where(~bad).where(norm > 0)
    return rows.groupBy("chunk_id", "model", "dimension").agg(F.max_by("vector", F.struct("embedded_at", "vector")).alias("vector"))


def tables_for(bits: int, similarity: float, recall: float = RECALL) -> int:
    """Tables of ``bits`` signs so that two vectors of the similarity share a cell of some table with chance ``recall``."""
    if bits == 0:
        return 1
    share = (1 - math.acos(similarity) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - share)))


def bits_for(vectors: int, cell: int = CELL) -> int:
    return max(0, math.ceil(math.log2(max(1, vectors) / cell)))


def _lines(model: str, dimension: int, what: int, n: int):
    """n random lines, the same wherever they are made."""
    import numpy as np
    import xxhash

    seed = xxhash.xxh3_64_intdigest(f"{model}\x1f{dimension}\x1f{what}")
    return np.random.default_rng(seed).standard_normal((n, dimension)).astype(np.float32)


def _sign(similarity: float):
    """For mapInArrow: each vector's cell in every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        lines: dict = {}
        for batch in batches:
            column = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            kinds = list(zip(column["model"].to_pylist(), column["dimension"].to_pylist(), column["bits"].to_pylist(), strict=True))
            cells: list = [None] * batch.num_rows
            for kind in set(kinds):
                own = [k for k, other in enumerate(kinds) if other == kind]
                model, dimension, bits = kind
                tables = tables_for(bits, similarity)
                if kind not in lines:
                    lines[kind] = _lines(model, dimension, 1, max(1, tables * bits))
                v = column["vector"].take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), dimension)
                signs = (v @ lines[kind].T > 0).astype(np.int64)
                for k, numbers in zip(own, (signs.reshape(len(own), tables, bits) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros((len(own), 1), dtype=np.int64)).tolist(), strict=True):
                    cells[k] = numbers
            yield pa.RecordBatch.from_arrays([*(column[c] for c in ("model", "dimension", "class", "vector")), pa.array(cells, pa.list_(pa.int64()))], names=["model", "dimension", "class", "vector", "cells"])

    return run


def count_collisions(places, half_widths: list[float], collisions: int = COLLISIONS, enough: int = ENOUGH, left: int | None = None):
    """Pairs (i, j), i < j, of rows that collide on at least ``collisions`` lines, by windows on sorted arrays.

    half_widths: the levels at which windows stop. A row that has ``enough`` candidates takes part in no wider level, unless as a
    partner. left: with it, only pairs of one row before it and one from it on count.
    """
    import numpy as np

    s, m = places.shape
    counts = np.zeros(s * s, dtype=np.uint8 if m < 256 else np.uint16)
    order = np.argsort(places, axis=0, kind="stable")
    found = np.zeros(0, dtype=np.int64)
    is_open = np.ones(s, dtype=bool)
    reach = [np.arange(1, s + 1) for _ in range(m)]  # how far each row's window has come on each line
    for width in half_widths:
        for line in range(m):
            at = order[:, line]
            sorted_places = places[at, line]
            stop = np.searchsorted(sorted_places, sorted_places + np.float32(width), "right")
            begin = reach[line]
            n = stop - begin
            total = int(n.sum())
            if total:
                first = np.repeat(np.arange(s), n)
                second = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
                a, b = at[first], at[second]
                low, high = np.minimum(a, b), np.maximum(a, b)
                counts[low * s + high] += 1  # a pair meets once on a line, so no place comes twice
            reach[line] = stop
        found = np.flatnonzero(counts >= collisions)
        a, b = found // s, found % s
        if not len(found):
            continue
        held = np.bincount(np.concatenate([a, b]), minlength=s)
        is_open = held < enough
        if not is_open.any():
            break
    a, b = found // s, found % s
    if left is not None:
        across = (a < left) & (b >= left)
        a, b = a[across], b[across]
    return a, b


def _near(half_widths: list[float], k: int, similarity: float):
    """For mapInArrow over entries sorted by cell and block: of every vector its k nearest of the cell that collide often enough.

    A cell of n vectors yields k rows for each of them at most, however many of them are alike. Rows beyond a vector's k nearest of
    a cell can't be among its k nearest of all.
    """
    names = ["a", "b", "cosine"]

    def nearest_of(places, v, classes: list[bytes], left: int | None) -> pa.RecordBatch | None:
        import numpy as np

        i, j = count_collisions(places, half_widths, left=left)
        cosines = np.concatenate([np.einsum("ij,ij->i", v[i[at : at + 65_536]], v[j[at : at + 65_536]]) for at in range(0, len(i), 65_536)]) if len(i) else np.zeros(0)
        fits = cosines >= similarity
        if not fits.any():
            return None
        i, j, cosines = i[fits], j[fits], cosines[fits]
        own, other, cosines = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([cosines, cosines])
        rank = np.empty(len(classes), dtype=np.int64)
        rank[sorted(range(len(classes)), key=classes.__getitem__)] = np.arange(len(classes))
        order = np.lexsort((rank[other], -cosines, own))
        own, other, cosines = own[order], other[order], cosines[order]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        kept = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own)))) < k
        return pa.RecordBatch.from_arrays([pa.array([classes[x] for x in own[kept]], pa.binary()), pa.array([classes[x] for x in other[kept]], pa.binary()), pa.array(cosines[kept], pa.float64())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        lines: dict = {}

        def rows() -> Iterator[tuple]:
            for batch in batches:
                vectors = batch.column(8)
                flat, starts = vectors.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(batch.column(1).to_numpy())])
                others = [batch.column(c).to_pylist() for c in range(8)]
                for at, head in enumerate(zip(*others, strict=True)):
                    yield *head, flat[starts[at] : starts[at + 1]]

        for (model, dimension, _, _, one, two), own in groupby(rows(), key=itemgetter(0, 1, 2, 3, 4, 5)):
            # own: (..., block of the row, class, vector); of a pair of blocks only pairs across count.
            members = sorted(((r[6], r[7], r[8]) for r in own), key=itemgetter(0, 1))
            if len(members) < 2:
                continue
            if (model, dimension) not in lines:
                lines[model, dimension] = _lines(model, dimension, 0, PROJECTIONS)
            v = np.stack([x[2] for x in members]).astype(np.float64)
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            found = nearest_of((v.astype(np.float32) @ lines[model, dimension].T).astype(np.float32), v, [x[1] for x in members], None if one == two else sum(x[0] == one for x in members))
            if found is not None:
                yield found

    return run


def top_per(df: DataFrame, key: str, order: list, k: int, spread: str, salts: int = 16) -> DataFrame:
    """The first k rows of each key: ranked within salted parts first, so that a hot key isn't ranked in one task."""
    salted = Window.partitionBy(key, F.pmod(F.xxhash64(spread), F.lit(salts))).orderBy(*order)
    first = df.withColumn("__rank", F.row_number().over(salted)).where(F.col("__rank") <= k).drop("__rank")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def similar_pairs(embeddings: DataFrame, k: int = 10, similarity: float = 0.9) -> DataFrame:
    """chunk_id, neighbour, cosine, rank: of every vector its k most similar ones of a cosine of ``similarity`` or more.

    Vectors are compared within a model and dimension; see clean_vectors for those that take no part. Equal vectors form a class,
    of which one is hashed; ties rank by chunk_id. Repeated rows count once, an empty table gives no rows. About 1 % of the
    pairs that are just at ``similarity`` may be missed, far fewer of closer ones; no pair below it comes out.
    """
    vectors = cut(clean_vectors(embeddings).withColumn("class", F.unhex(F.substring(F.sha2(F.concat_ws(",", "model", "dimension", F.transform("vector", lambda x: x.cast("string"))), 256), 1, 32))))
    classes = vectors.groupBy("model", "dimension", "class").agg(F.first("vector").alias("vector"))
    sizes = classes.groupBy("model", "dimension").agg(F.count(F.lit(1)).alias("n"))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / F.lit(float(CELL))))).cast("int")
    sized = classes.join(sizes.select("model", "dimension", bits.alias("bits")), ["model", "dimension"])
    hashed = cut(sized.select("model", "dimension", "bits", "class", "vector").mapInArrow(_sign(similarity), "model string, dimension int, class binary, vector array<float>, cells array<bigint>"))
    where = ["model", "dimension", "table", "cell"]
    entries = hashed.select("model", "dimension", "class", "vector", F.posexplode("cells").alias("table", "cell"))
    # Cells beyond the bound, seldom any: blocks of half the bound, every pair of them in a task of its own.
    large = cut(entries.groupBy(*where).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL_MOST).select(*where, F.ceil(F.col("n") / F.lit(CELL_MOST / 2)).cast("int").alias("blocks")))
    zero = F.lit(0).alias
    if large.isEmpty():
        spread = entries.select(*where, zero("one"), zero("two"), zero("block"), "class", "vector")
    else:
        blocked = entries.join(large, where, "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"), F.lit(0)))
        others = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
        spread = blocked.withColumn("other", F.explode(others)).select(*where, F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "class", "vector")
    grouped = spread.repartition(*where, "one", "two").sortWithinPartitions(*where, "one", "two")
    distance = math.sqrt(2 - 2 * similarity)
    found = grouped.mapInArrow(_near([WIDTH * distance * x for x in LEVELS], k, similarity), "a binary, b binary, cosine double")
    nearest = top_per(found.groupBy("a", "b").agg(F.max("cosine").alias("cosine")), "a", [F.desc("cosine"), F.asc("b")], k, "b").select("a", "b", "cosine")
    # Members: of each class the first k + 1 are enough as neighbours.
    firsts = top_per(vectors.select("class", "chunk_id"), "class", [F.asc("chunk_id")], k + 1, "chunk_id").select(F.col("class").alias("b"), F.col("chunk_id").alias("neighbour"))
    own = vectors.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(1.0).alias("cosine"))
    lists = top_per(nearest.unionByName(own).join(firsts, "b"), "a", [F.desc("cosine"), F.asc("neighbour")], k + 1, "neighbour").select(F.col("a").alias("class"), "neighbour", "cosine")
    pairs = vectors.select("class", "chunk_id").join(lists, "class").where(F.col("chunk_id") != F.col("neighbour")).select("chunk_id", "neighbour", "cosine")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("cosine"), F.asc("neighbour"))))
    return ranked.where(F.col("rank") <= k)


#: For a stated set of queries against all rows: lines, collisions of a candidate, vectors of a block, queries of a block, and the
#: share of a block that widening goes on to have as candidates.
SEARCH_LINES, SEARCH_COLLISIONS, SEARCH_BLOCK, QUERY_BLOCK, SEARCH_SHARE = 64, 46, 4096, 512, 0.15
#: Half-widths of the windows, from a near copy's to one that holds nearly everything.
SEARCH_WIDTHS = (0.15, 0.4, 0.7, 0.9, 1.05, 1.15, 1.25, 1.35, 1.5, 1.75, 2.1, 3.0, 1e9)


def _search(k: int):
    """For mapInArrow over pairs of a block of queries and a block of vectors: the queries' k nearest of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        lines: dict = {}
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for row in range(batch.num_rows):
                model, dimension, q_ids, q, ids, v = (column[c][row].as_py() for c in ("model", "dimension", "query_ids", "queries", "ids", "vectors"))
                if (model, dimension) not in lines:
                    lines[model, dimension] = _lines(model, dimension, 2, SEARCH_LINES)
                unit = lambda x: (m := np.array(x, dtype=np.float64)) / np.linalg.norm(m, axis=1, keepdims=True)
                q, v, ids = unit(q), unit(v), np.array(ids)
                places = (v @ lines[model, dimension].T).astype(np.float32)
                order = np.argsort(places, axis=0, kind="stable")
                sorted_places = np.take_along_axis(places, order, axis=0)
                own = (q @ lines[model, dimension].T).astype(np.float32)
                enough = min(len(ids), max(5 * k, int(SEARCH_SHARE * len(ids))))
                out: list[tuple[int, int, float]] = []
                for i, query in enumerate(q_ids):
                    counts = np.zeros(len(ids), dtype=np.int16)
                    low = high = None
                    for width in SEARCH_WIDTHS:
                        to_low = [int(np.searchsorted(sorted_places[:, t], own[i, t] - width, "left")) for t in range(SEARCH_LINES)]
                        to_high = [int(np.searchsorted(sorted_places[:, t], own[i, t] + width, "right")) for t in range(SEARCH_LINES)]
                        for t in range(SEARCH_LINES):
                            # Only what the window has gained on either side is counted.
                            if low is None:
                                counts[order[to_low[t] : to_high[t], t]] += 1
                            else:
                                counts[order[to_low[t] : low[t], t]] += 1
                                counts[order[high[t] : to_high[t], t]] += 1
                        low, high = to_low, to_high
                        candidates = np.flatnonzero(counts >= SEARCH_COLLISIONS)
                        if len(candidates) >= enough:
                            break
                    candidates = candidates[ids[candidates] != query]
                    cosines = v[candidates] @ q[i]
                    for j in np.lexsort((ids[candidates], -cosines))[:k]:
                        out.append((query, int(ids[candidates[j]]), float(cosines[j])))
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64())], names=["chunk_id", "neighbour", "cosine"])

    return run


def nearest(embeddings: DataFrame, is_query, k: int = 10) -> DataFrame:
    """chunk_id, neighbour, cosine, rank: of each query its k most similar vectors of all rows, however similar they are.

    is_query: a condition on chunk_id. Queries and vectors are hashed into blocks of bounded size; each pair of blocks is a row of
    its own, spread by the vectors' block, and yields k rows per query, which merge. Every row is searched; what isn't found is what
    collides too seldom (the recall against brute force is tested; see the README). Ties rank by neighbour; empty tables give no rows.
    """
    vectors = cut(clean_vectors(embeddings))
    sizes = vectors.groupBy("model", "dimension").agg(F.ceil(F.count(F.lit(1)) / SEARCH_BLOCK).cast("int").alias("blocks"), F.ceil(F.count_if(is_query) / QUERY_BLOCK).cast("int").alias("query_blocks"))
    rows = vectors.join(sizes, ["model", "dimension"])
    block = lambda n: F.pmod(F.xxhash64("chunk_id"), F.greatest(F.col(n), F.lit(1))).cast("int")
    keyed = rows.withColumn("block", block("blocks")).groupBy("model", "dimension", "block").agg(F.collect_list("chunk_id").alias("ids"), F.collect_list("vector").alias("vectors"))
    asked = rows.where(is_query).withColumn("query_block", block("query_blocks")).groupBy("model", "dimension", "query_block").agg(F.collect_list("chunk_id").alias("query_ids"), F.collect_list("vector").alias("queries"), F.first("blocks").alias("blocks"))
    spread = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = spread.join(keyed, ["model", "dimension", "block"]).select("model", "dimension", "query_ids", "queries", "ids", "vectors")
    found = pairs.mapInArrow(_search(k), "chunk_id bigint, neighbour bigint, cosine double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("cosine"), F.asc("neighbour"))))
    return ranked.where(F.col("rank") <= k)
