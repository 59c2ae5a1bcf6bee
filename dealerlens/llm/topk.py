"""Exact top-k inner-product search on a bit-sliced index.

Rows are indexed in blocks.  In a block, bit b of (quantised attribute d) of all rows is
one bitmap ("slice").  For a query the index adds the attributes, each weighted by the
query's own component, with bitmap arithmetic only: every set bit of a weight adds the
attribute's slices, shifted, through carry-save adders, then one ripple pass gives the
slices of the score.  The top rows are chosen from the most significant slice downward
with bitmap counts; the rows that tie at the boundary are resolved exactly, by id.

Rows are dealt to groups of about ``ROWS_PER_GROUP``, and a group's index is built once, in one task,
a block at a time.  The queries are sent to every group, arrive behind its rows and stream past
its index; so what is shuffled is every row once and every query once a group.  A block whose
attributes' ranges allow no score above the k found so far is passed over.  Nothing is broadcast
or collected, and a group gives k rows per query at most.

Defined results: vectors that are null, or hold a null or non-finite component, take no
part; shorter and longer vectors than others count as padded with zeros; an empty table gives no
rows; rows with the same id are candidates each, but a query meets no row of its own id; repeated
query rows of one id are answered once, for the least of their vectors; a null id takes no part; components
of any finite size are exact: blocks that hold large ones count in Python's integers, and a
score beyond 64 bits, ranked exactly among its group's, is given as the nearest 64-bit number; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import lean, table

ROWS_PER_BLOCK = 16384
ROWS_PER_GROUP = 131_072
#: Quantised components to this size are summed in 64 bits (for up to 2^10 attributes).
NARROW = 1 << 26
LONG = (1 << 63) - 1


def quantised(vector: np.ndarray, scale: float) -> list[int]:
    """floor(scale * x) of the components, exactly."""
    scaled = vector * scale
    if (np.abs(scaled) < NARROW).all():
        return np.floor(scaled).astype(np.int64).tolist()
    return [math.floor(scale * x) if math.isfinite(scale * x) else math.floor(Fraction(scale) * Fraction(x)) for x in vector.tolist()]


def vectors_of(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list column without nulls."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(flat, ends[:-1])


class SlicedBlock:
    """Bit slices of one block of rows.  Attributes are shifted to be non-negative: with
    m the attribute's least value, x = (x - m) + m, and the constant part is added once.
    ``values`` are int64, or Python's integers where they are large."""

    @classmethod
    def of(cls, rows: list[tuple[int, np.ndarray]], scale: float) -> SlicedBlock:
        """The block of (id, vector) rows."""
        width = max(len(v) for _, v in rows)
        scaled = np.zeros((len(rows), width))
        for row, (_, v) in zip(scaled, rows, strict=True):
            row[: len(v)] = v * scale
        if width <= 1024 and (np.abs(scaled) < NARROW).all():
            values = np.floor(scaled).astype(np.int64)
        else:
            values = np.zeros((len(rows), width), object)
            for row, (_, v) in zip(values, rows, strict=True):
                row[: len(v)] = quantised(v, scale)
        return cls(np.asarray([i for i, _ in rows], np.int64), values)

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.rows, self.width = self.values.shape
        self.words = (self.rows + 63) // 64
        self.low = self.values.min(0) if self.rows else np.zeros(self.width, np.int64)
        self.high = self.values.max(0) if self.rows else self.low
        shifted = self.values - self.low if self.rows else self.values
        depth = [int(shifted[:, d].max(initial=0)).bit_length() for d in range(self.width)]
        straight = [self._bitmap(shifted[:, d] >> b & 1) for d in range(self.width) for b in range(depth[d])]
        self.depth, self.first = depth, np.concatenate([[0], np.cumsum(depth)]).astype(int)
        stacked = np.asarray(straight, np.uint64).reshape(len(straight), self.words)
        #: The slices of all attributes, then the same inverted, for negative weights.
        self.slices = np.concatenate([stacked, ~stacked])
        self.every = self._bitmap(np.ones(self.rows, dtype=np.int64))

    def _bitmap(self, bits: np.ndarray) -> np.ndarray:
        packed = np.packbits(bits.astype(np.uint8), bitorder="little")
        return np.frombuffer(packed.tobytes().ljust(self.words * 8, b"\0"), dtype=np.uint64)

    def weighted_sum(self, weights: np.ndarray) -> tuple[list[np.ndarray], int]:
        """(slices of the score minus its least possible value, that constant)."""
        base = sum(w * int(x) for w, x in zip(weights.tolist(), self.low, strict=True))
        n = int(self.first[-1])
        chosen: dict[int, list[int]] = {}
        for d, w in enumerate(weights.tolist()):
            if w < 0:  # w * s = |w| * (top - s) - |w| * top: the slices inverted
                base += w * ((1 << self.depth[d]) - 1)
            own = range(int(self.first[d]) + n * (w < 0), int(self.first[d]) + n * (w < 0) + self.depth[d])
            for shift in range(abs(w).bit_length()):
                if abs(w) >> shift & 1:
                    for b, s in enumerate(own):
                        chosen.setdefault(shift + b, []).append(s)
        total, at, carried = [], 0, []
        while carried or (chosen and at <= max(chosen)):
            parts = [self.slices[chosen[at]], *carried] if at in chosen else carried
            pile, carried = np.concatenate(parts) if parts else np.zeros((0, self.words), np.uint64), []
            while len(pile) > 2:  # carry-save: three slices become a sum and a carry
                m = len(pile) // 3
                a, b, c = pile[:m], pile[m : 2 * m], pile[2 * m : 3 * m]
                half = a ^ b
                carried.append((a & b) | (half & c))
                pile = np.concatenate([half ^ c, pile[3 * m :]])
            if len(pile) == 2:
                carried.append((pile[0] & pile[1])[None])
                pile = (pile[0] ^ pile[1])[None]
            total.append(pile[0] if len(pile) else np.zeros(self.words, np.uint64))
            at += 1
        return total, base

    def best_possible(self, weights: list[int]) -> int:
        return sum(w * int(high if w > 0 else low) for w, low, high in zip(weights, self.low, self.high, strict=False))

    def top(self, weights: list[int], k: int, own) -> list[tuple[int, int]]:
        """The (id, score) of the k best rows whose id is not ``own``; ties to smaller ids."""
        given = [*weights[: self.width], *[0] * (self.width - len(weights))]
        narrow = self.values.dtype == np.int64 and all(-NARROW < w < NARROW for w in given)
        weights = np.asarray(given, np.int64 if narrow else object)
        slices, _ = self.weighted_sum(weights)
        allowed = self.every
        if own is not None:
            at = slice(*np.searchsorted(self.ids, [own, own + 1]))
            if at.start < at.stop:
                allowed = allowed.copy()
                for i in range(at.start, at.stop):
                    allowed[i // 64] &= ~np.uint64(1 << (i % 64))
        sure, open_rows, left = np.zeros(self.words, np.uint64), allowed, k
        for s in reversed(slices):
            ones = open_rows & s
            n = int(np.bitwise_count(ones).sum())
            if n > left:
                open_rows = ones
            else:
                sure, open_rows, left = sure | ones, open_rows & ~s, left - n
                if not left:
                    break
        rows = self._rows(sure)
        if left:
            rows = np.concatenate([rows, self._rows(open_rows)[:left]])
        scores = self.values[rows] @ weights if narrow else (self.values[rows].astype(object) * weights).sum(1)
        found = [(int(i), int(x)) for i, x in zip(self.ids[rows], scores, strict=True)]
        return sorted(found, key=lambda f: (-f[1], f[0]))

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        words = np.flatnonzero(bitmap)
        found = [w * 64 + np.flatnonzero(np.unpackbits(bitmap[w : w + 1].view(np.uint8), bitorder="little")) for w in words]
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def best_of(blocks: list[SlicedBlock], weights: list[int], k: int, own) -> list[tuple[int, int]]:
    """The k best of all blocks, with scores as 64-bit numbers."""
    best: list[tuple[int, int]] = []
    for block in blocks:
        if len(best) < k or block.best_possible(weights) >= best[-1][1]:
            best = sorted([*best, *block.top(weights, k, own)], key=lambda f: (-f[1], f[0]))[:k]
    return [(i, max(-LONG - 1, min(LONG, x))) for i, x in best]


def _usable(v: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return v.isNotNull() & F.forall(v, finite)


def exact_top_k(rows: DataFrame, queries: DataFrame, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, rows_per_block: int = ROWS_PER_BLOCK, rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of the highest score for each query."""
    take = [F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")]
    usable = lambda df: df.select(take).filter(F.col("id").isNotNull() & _usable(F.col("v")))
    indexed = usable(rows)
    n_groups = max(1, -(-indexed.count() // rows_per_group))
    asked = usable(queries).groupBy("id").agg(F.min("v").alias("v"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_groups - 1).cast("long")))
    own = indexed.select(F.pmod(F.xxhash64("id", "v"), F.lit(n_groups)).alias("g"), F.lit(0).alias("asks"), "id", "v")
    dealt = own.unionByName(asked.select(every.alias("g"), F.lit(1).alias("asks"), "id", "v"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks, waiting, out = None, [], [], []
        made = lambda: pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(3)]
            vectors = batch.column(3)
            at = 0
            while at < batch.num_rows:
                end = at + 1  # a run of rows of one group and kind
                while end < batch.num_rows and columns[0][end] == columns[0][at] and columns[1][end] == columns[1][at]:
                    end += 1
                if columns[0][at] != now:
                    now, blocks, waiting = columns[0][at], [], []
                part = zip(columns[2][at:end], vectors_of(vectors.slice(at, end - at)), strict=True)
                if not columns[1][at]:
                    waiting += part
                    while len(waiting) >= rows_per_block:
                        blocks.append(SlicedBlock.of(waiting[:rows_per_block], scale))
                        waiting = waiting[rows_per_block:]
                else:
                    if waiting:
                        blocks.append(SlicedBlock.of(waiting, scale))
                        waiting = []
                    for key, vector in part:
                        out += [(key, i, s) for i, s in best_of(blocks, quantised(vector, scale), k, key)]
                        if len(out) > 20_000:
                            yield made()
                            out = []
                at = end
        yield made()

    ordered = dealt.repartition("g").sortWithinPartitions("g", "asks", "id")
    found = ordered.mapInArrow(lean(search), "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_exact_top_k(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return exact_top_k(rows, rows.filter("vec_id % 50 = 0"))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""
