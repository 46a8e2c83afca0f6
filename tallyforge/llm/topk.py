"""Exact nearest vectors by inner product over a bit-sliced index.

Components are integers, floor(1024 x). A block of up to 65536 vectors stores each component,
without its lowest bits, as bit slices: one bitmap per bit. A query adds the slices that the signed
binary digits of its own (also shortened) components ask for with full adders on whole bitmaps, which
gives the slices of all scores of the block. Going from the most significant slice downward finds
the k-th best shortened score. What shortening can have changed is bounded by Cauchy and Schwarz with
norms taken from the block itself, so all rows that may still be among the k best are known; their
scores are computed exactly from the full integers.

Blocks are packed where their rows are read. Query blocks are sent to every slot of row blocks, so
what is shuffled is queries times slots, not pairs; each task holds one block of rows and one of queries,
and gives k rows per query on, of which k are kept again before and after the last shuffle.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, as
query or candidate; a shorter vector is taken as ending in zeros; ties go to the smaller vec_id; rows with the same
vec_id as the query are not its candidates; a repeated candidate row counts each time; of a query id with several usable vectors
the least one (by its components in order) is asked; vectors with a component of 2**20 or more in size stand in blocks of their own and are compared
exactly on Python's integers, whatever the size; a score beyond a long is given as the
largest or smallest long, but ranked by its true value; with fewer than k candidates all are given; an empty table gives no row; other
columns are never read.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, kept, shipped

SCALE = 1024
ROWS_PER_BLOCK, QUERIES_PER_BLOCK = 1 << 16, 256
#: Lowest bits that slices leave out, of rows and of queries.
DROPPED = 4
_LARGEST = 1 << 20


def digits(value: int) -> list[tuple[int, int]]:
    """(shift, sign) of the signed binary digits without two neighbours that are both set."""
    out, shift = [], 0
    while value:
        if value & 1:
            sign = 2 - (value & 3)
            out.append((shift, sign))
            value -= sign
        value >>= 1
        shift += 1
    return out


class Slices:
    """The bit-sliced index of one block of integer vectors."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows  # n x d, int64
        self.n = len(rows)
        coarse = rows >> DROPPED
        self.low = coarse.min(axis=0)
        part = rows - (coarse << DROPPED) - (1 << (DROPPED - 1))  # what the slices leave out, about the middle
        self.left_out = float(np.sqrt((part.astype(np.float64) ** 2).sum(axis=1).max()))
        self.norm = float(np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1).max()))
        above = (coarse - self.low).astype(np.uint64)
        pad = -self.n % 64
        self.planes: list[list[np.ndarray]] = []
        for i in range(rows.shape[1]):
            column = above[:, i]
            bits = int(column.max()).bit_length()
            self.planes.append([np.packbits(np.pad(((column >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), (0, pad)), bitorder="little").view(np.uint64)
                                for b in range(bits)])
        self.all = np.packbits(np.pad(np.ones(self.n, dtype=np.uint8), (0, pad)), bitorder="little").view(np.uint64)

    def scores(self, weights: list[int]) -> tuple[list[np.ndarray], int]:
        """Slices of the sum of weight times stored component, less a constant that is given too."""
        levels: list[list[np.ndarray]] = []
        constant = 0
        for i, weight in enumerate(weights):
            constant += weight * int(self.low[i])
            for shift, sign in digits(weight):
                planes = self.planes[i]
                while len(levels) < shift + len(planes):
                    levels.append([])
                for b, plane in enumerate(planes):
                    levels[shift + b].append(plane if sign > 0 else ~plane)
                if sign < 0:  # -u is the complement of u, less its largest value
                    constant -= ((1 << len(planes)) - 1) << shift
        out = []
        level = 0
        while level < len(levels):
            planes = levels[level]
            while len(planes) > 1:
                if level + 1 == len(levels):
                    levels.append([])
                if len(planes) == 2:
                    a, b = planes
                    levels[level + 1].append(a & b)
                    planes = [a ^ b]
                else:
                    a, b, c, *planes = planes
                    half = a ^ b
                    planes.append(half ^ c)
                    levels[level + 1].append((a & b) | (half & c))
            out.append(planes[0] if planes else np.zeros_like(self.all))
            level += 1
        return out, constant

    def boundary(self, query: np.ndarray, k: int) -> np.ndarray:
        """Places of all rows that may be among the k best for the query."""
        if self.n <= k:
            return np.arange(self.n)
        half = 1 << (DROPPED - 1)
        short = (query + half) >> DROPPED
        error = float(np.sqrt(((query - (short << DROPPED)).astype(np.float64) ** 2).sum())) * self.norm \
            + float(np.sqrt(((short << DROPPED).astype(np.float64) ** 2).sum())) * self.left_out
        # the true score lies within ``error`` of the shortened one times 2**(2 * DROPPED) plus a constant
        margin = int(2 * error / (1 << 2 * DROPPED)) + 2
        slices, _ = self.scores([int(x) for x in short])
        best, chosen = 0, self.all
        sure = 0  # rows surely above the k-th best
        for b in range(len(slices) - 1, -1, -1):
            upper = chosen & slices[b]
            count = sure + int(np.bitwise_count(upper).sum())
            if count >= k:
                chosen, best = upper, best | (1 << b)
            else:
                sure, chosen = count, chosen & ~slices[b]
        return self._at_least(slices, best - margin)

    def _at_least(self, slices: list[np.ndarray], bound: int) -> np.ndarray:
        if bound <= 0:
            return np.arange(self.n)
        above, equal = np.zeros_like(self.all), self.all
        for b in range(len(slices) - 1, -1, -1):
            if bound >> b & 1:
                equal = equal & slices[b]
            else:
                above = above | (equal & slices[b])
                equal = equal & ~slices[b]
        return np.flatnonzero(np.unpackbits((above | equal).view(np.uint8), bitorder="little")[:self.n])


def integers(vector: list | None) -> list[int] | None:
    """floor(1024 x) of each component; None where the vector takes no part."""
    if not vector or any(x is None for x in vector):
        return None
    values = np.asarray(vector, dtype=np.float64)
    if not np.isfinite(values).all():
        return None
    return [int(math.floor(x * SCALE)) if abs(x) < 2**53 else int(x) * SCALE for x in values.tolist()]


def _grid(rows: list[list[int]], kind) -> np.ndarray:
    """Rows of one width, shorter ones ending in zeros."""
    grid = np.zeros((len(rows), max(map(len, rows))), dtype=kind)
    for i, row in enumerate(rows):
        grid[i, :len(row)] = row
    return grid


def _pack(ids: list[int], rows: list[list[int]], wide: bool) -> bytes:
    return json.dumps([ids, rows]).encode() if wide else np.column_stack([ids, _grid(rows, np.int64)]).astype("<i8").tobytes()


def _unpack(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and rows; the rows of a wide block (width 0) are Python's integers."""
    if not width:
        ids, rows = json.loads(data)
        return np.array(ids, dtype=np.int64), _grid(rows, object)
    both = np.frombuffer(data, dtype="<i8").reshape(-1, width + 1)
    return both[:, 0], both[:, 1:]


_BLOCK = pa.schema([("width", pa.int32()), ("n", pa.int64()), ("block", pa.binary())])
WIDE_ROWS_PER_BLOCK = 1 << 12


def packed(vectors: DataFrame, id_column: str, vector_column: str, size: int) -> DataFrame:
    """Blocks of up to ``size`` integer vectors, packed where they are read; those with a large component apart, as blocks of width 0."""

    def blocks(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[bool, tuple[list[int], list[list[int]]]] = {False: ([], []), True: ([], [])}

        def flushed(wide: bool):
            ids, rows = waiting[wide]
            waiting[wide] = ([], [])
            width = 0 if wide else max(map(len, rows))
            return pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([len(rows)], pa.int64()), pa.array([_pack(ids, rows, wide)], pa.binary())], schema=_BLOCK)

        for batch in source:
            for key, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = integers(vector) if key is not None else None
                if found is not None:
                    wide = max(map(abs, found)) >= _LARGEST
                    waiting[wide][0].append(key)
                    waiting[wide][1].append(found)
                    if len(waiting[wide][0]) == (min(size, WIDE_ROWS_PER_BLOCK) if wide else size):
                        yield flushed(wide)
        for wide, (ids, _) in list(waiting.items()):
            if ids:
                yield flushed(wide)

    shipped(vectors.sparkSession)
    return vectors.select(id_column, vector_column).mapInArrow(blocks, "width int, n long, block binary")


def best_of_block(row_ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(query id, row id, score) of the k best rows of the block for each query, ties to the smaller id."""
    width = max(rows.shape[1], queries.shape[1])
    rows = np.pad(rows, ((0, 0), (0, width - rows.shape[1])))
    queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    plain = rows.dtype == queries.dtype == np.int64 and max(np.abs(rows).max(initial=0), np.abs(queries).max(initial=0)) < _LARGEST
    index = Slices(rows) if plain else None
    if index is None:
        rows, queries = rows.astype(object), queries.astype(object)
    for query_id, query in zip(query_ids.tolist(), queries):
        own = int(np.count_nonzero(row_ids == query_id))
        places = index.boundary(query, k + own) if index else np.arange(len(rows))
        places = places[row_ids[places] != query_id]
        scores = rows[places] @ query
        if index:
            best = np.lexsort((row_ids[places], -scores))[:k].tolist()
        else:
            best = sorted(range(len(places)), key=lambda i: (-scores[i], row_ids[places[i]]))[:k]
        for i in best:
            yield query_id, int(row_ids[places[i]]), int(scores[i])


_MOST, _BYTES = (1 << 63) - 1, 272


def as_long(score: int) -> tuple[int, bytes | None]:
    """The score within a long, and for one at its ends or beyond them bytes in the order of the true values."""
    if abs(score) < _MOST:
        return score, None
    return max(-_MOST, min(_MOST, score)), (score + (1 << (8 * _BYTES - 1))).to_bytes(_BYTES, "big")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding",
            rows_per_block: int = ROWS_PER_BLOCK, queries_per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k rows of ``vectors`` with the highest inner product for each query."""
    rows = kept(packed(vectors, id_column, vector_column, rows_per_block), "vector-blocks")
    usable = F.forall(vector_column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    single = queries.where(F.col(id_column).isNotNull() & (F.size(vector_column) > 0) & usable).groupBy(id_column).agg(F.min(vector_column).alias(vector_column))
    asked = packed(single, id_column, vector_column, queries_per_block)
    slots = max(1, rows.count())  # one row per block
    rows = rows.withColumn("slot", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(slots)))
    asked = asked.select(F.col("width").alias("query_width"), F.col("block").alias("query_block"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    pairs = rows.join(asked, "slot").select("width", "block", "query_width", "query_block")

    def scored(batch: pa.RecordBatch):
        for width, block, query_width, query_block in zip(*(batch.column(i) for i in range(4))):
            row_ids, block_rows = _unpack(block.as_py(), width.as_py())
            query_ids, block_queries = _unpack(query_block.as_py(), query_width.as_py())
            found = list(best_of_block(row_ids, block_rows, query_ids, block_queries, k))
            scores = [as_long(x[2]) for x in found]
            yield {"query_id": [x[0] for x in found], "vec_id": [x[1] for x in found], "score": [x[0] for x in scores], "beyond": [x[1] for x in scores]}

    fields = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("beyond", pa.binary())])
    best = batches(pairs, scored, "query_id long, vec_id long, score long, beyond binary", fields)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_last("beyond"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
