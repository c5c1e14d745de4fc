"""Operator 8, exact top-k search by inner product, pruned with multi-resolution segment statistics.

Vectors are cut into segments at several resolutions, down to segments of two components. With a segment's mean and
deviation from it, Cauchy-Schwarz bounds the inner product of two segments: length * mean * mean + deviation * deviation;
equivalently it bounds their distance from below. The bounds are taken coarse to fine for each pair of a query and a row,
against the query's running k-th best score; only pairs that pass the finest get an exact score. The bounds carry a
rounding allowance, so no pair that belongs in the result is lost. A bounded sample of rows (`pilots`) is scored first:
a query's k-th best score among them is a lower limit of its k-th best among all, so pruning works from the first row on.

Scores are exact integers of any size: products that doubles hold exactly are taken in doubles, others in 64-bit or longer
integers. Rows are ranked by the exact score; where it does not fit a long, the result shows the nearest long.

All rows are scanned once, whatever the number of queries. Queries of up to `broadcast_bytes` (checked) are broadcast;
more are dealt out, with the rows, to groups of rows of `group_bytes` by one shuffle, and stream past each group.

Defined cases: vectors that are null, empty or hold null or non-finite components (or components whose scaled value is not
finite) take no part, nor do rows with a null id; vectors of another length than the query's are no candidates for it; a
candidate with the query's own id is left out; equal scores go to the smaller id; repeated rows each count as a candidate,
but equal query rows are one query (rows of one id with different vectors are queries of their own); other columns are not
read, so clashing names do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import ship

SCALE = 1024
ROWS_AT_ONCE, QUERIES_AT_ONCE, PAIRS_AT_ONCE = 2048, 512, 1 << 15
EXACT = 2.0**53
LEAST_LONG, MOST_LONG = -(1 << 63), (1 << 63) - 1


def quantize(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, v): floor(scale * x) of every usable vector, as whole doubles."""
    scaled = F.transform(vector_col, lambda x: x.cast("double") * F.lit(float(scale)))
    finite = F.forall("d", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col(id_col).cast("long").alias("id"), scaled.alias("d")).filter(F.col("id").isNotNull() & (F.size("d") > 0) & finite)
    # doubles from 2^53 on are whole
    return rows.select("id", F.transform("d", lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)).alias("v"))


def resolutions(dim: int) -> list[int]:
    """Segments at each level: 1, 4, 16, ... while segments keep 4 components or more, and at last segments of two."""
    out = [1]
    while dim // (out[-1] * 4) >= 4:
        out.append(out[-1] * 4)
    return [*out, dim // 2] if dim // 2 > out[-1] else out


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """A row's segment means and deviations, weighted so that the dot product of two rows' statistics bounds their inner product from above."""
    edges = np.linspace(0, x.shape[1], segments + 1).astype(int)
    size = np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], 1) / size
    spread = np.sqrt(np.add.reduceat((x - np.repeat(mean, size, 1)) ** 2, edges[:-1], 1))
    return np.concatenate([mean * np.sqrt(size), spread], 1)


class Rows:
    """Some rows of one dimension with their statistics."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x.astype(np.float64)
        with np.errstate(all="ignore"):
            self.stats = [statistics(self.x, s) for s in resolutions(x.shape[1])]
            self.most = np.abs(self.x).max(1)
            self.norm = np.sqrt((self.x**2).sum(1))


def exact_scores(q: Rows, r: Rows, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, bool]:
    """Inner products of the pairs (q[i], r[j]) as integers, and whether they are an object array of Python's."""
    with np.errstate(over="ignore"):
        size = q.most[i] * r.most[j] * q.x.shape[1]
    if not len(i) or size.max() < EXACT:
        return np.einsum("ij,ij->i", q.x[i], r.x[j]).astype(np.int64), False
    if size.max() < EXACT * 512 and q.most[i].max() < EXACT and r.most[j].max() < EXACT:
        return np.einsum("ij,ij->i", q.x[i].astype(np.int64), r.x[j].astype(np.int64)), False
    out = np.empty(len(i), object)
    for n, (a, b) in enumerate(zip(i, j, strict=True)):
        out[n] = sum(int(u) * int(v) for u, v in zip(q.x[a].tolist(), r.x[b].tolist(), strict=True))
    return out, True


class Block:
    """Queries of one dimension with their running best k."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.q, self.k = Rows(ids, vectors), k
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, id), best first
        self.least = np.full(len(ids), -np.inf) if floor is None else floor.astype(np.float64)
        self.pairs = self.scored = 0

    def add(self, r: Rows) -> None:
        alive = self.q.ids[:, None] != r.ids[None, :]
        self.pairs += int(alive.sum())
        rows = np.arange(len(r.ids))
        if np.isfinite(self.least).any():
            with np.errstate(all="ignore"):
                for mine, other in zip(self.q.stats, r.stats, strict=True):
                    bound = mine @ other[rows].T
                    # what rounding can take from a bound, and from the limit
                    bound += 1e-9 * self.q.norm[:, None] * r.norm[rows][None, :] + 1e-6
                    alive &= ~(bound < (self.least - 1e-12 * np.abs(self.least))[:, None])
                    keep = alive.any(0)
                    rows, alive = rows[keep], alive[:, keep]
                    if not len(rows):
                        return
        i, j = np.nonzero(alive)
        self.scored += len(i)
        for at in range(0, len(i), PAIRS_AT_ONCE):
            self._score(r, i[at : at + PAIRS_AT_ONCE], rows[j[at : at + PAIRS_AT_ONCE]])

    def _score(self, r: Rows, i: np.ndarray, j: np.ndarray) -> None:
        score, long = exact_scores(self.q, r, i, j)
        if long:
            found: dict[int, list[tuple[int, int]]] = {}
            for a, s, w in zip(i.tolist(), score.tolist(), r.ids[j].tolist(), strict=True):
                found.setdefault(a, []).append((-s, w))
        else:
            with np.errstate(invalid="ignore"):
                near = score >= self.least[i] - np.abs(self.least[i]) * 1e-12
            i, score, who = i[near], score[near], r.ids[j[near]]
            order = np.lexsort((who, -score, i))
            i, score, who = i[order], score[order], who[order]
            start = np.flatnonzero(np.diff(i, prepend=-1))
            found = {}
            for a, z in zip(start, [*start[1:], len(i)], strict=False):
                z = min(z, a + self.k)
                found[int(i[a])] = list(zip((-score[a:z]).tolist(), who[a:z].tolist(), strict=True))
        for a, new in found.items():
            self.best[a] = sorted(self.best[a] + new)[: self.k]
            if len(self.best[a]) == self.k:
                try:
                    self.least[a] = max(self.least[a], float(-self.best[a][-1][0]))
                except OverflowError:
                    pass


def _vectors(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of a list column, one for each length of vector."""
    lists = batch.column(column)
    sizes = np.asarray(lists.value_lengths())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes).tolist():
        fit = np.flatnonzero(sizes == d)
        yield fit, flat[starts[fit][:, None] + np.arange(d)]


def _key(score: int) -> bytes:
    """Bytes that order scores which the same long shows."""
    if LEAST_LONG <= score <= MOST_LONG:
        return b"\x80"
    raw = abs(score).to_bytes((abs(score).bit_length() + 7) // 8, "big")
    raw = len(raw).to_bytes(4, "big") + raw
    return b"\xff" + raw if score > 0 else b"\x00" + bytes(255 - b for b in raw)


RESULT = "query_id long, query_hash long, vec_id long, score long, key binary"


def _found(blocks: list[tuple[np.ndarray, Block]]) -> Iterator[pa.RecordBatch]:
    for hashes, block in blocks:
        rows = [(q, h, w, -s) for q, h, best in zip(block.q.ids.tolist(), hashes.tolist(), block.best, strict=True) for s, w in best]
        if rows:
            q, h, w, s = zip(*rows, strict=True)
            shown = [min(max(x, LEAST_LONG), MOST_LONG) for x in s]
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(h, pa.int64()), pa.array(w, pa.int64()), pa.array(shown, pa.int64()), pa.array([_key(x) for x in s], pa.binary())], ["query_id", "query_hash", "vec_id", "score", "key"])


def _blocks(queries: pa.RecordBatch | pa.Table, k: int) -> dict[int, list[tuple[np.ndarray, Block]]]:
    """Blocks of (id, hash, floor, v) rows by dimension."""
    out: dict[int, list[tuple[np.ndarray, Block]]] = {}
    for batch in queries.to_batches() if isinstance(queries, pa.Table) else [queries]:
        ids, hashes, floor = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
        for at, x in _vectors(batch, 3):
            for lo in range(0, len(at), QUERIES_AT_ONCE):
                own = at[lo : lo + QUERIES_AT_ONCE]
                out.setdefault(x.shape[1], []).append((hashes[own], Block(ids[own], x[lo : lo + QUERIES_AT_ONCE], k, floor[own])))
    return out


def _feed(blocks: dict[int, list[tuple[np.ndarray, Block]]], batch: pa.RecordBatch, id_column: int, v_column: int) -> None:
    for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
        part = batch.slice(lo, ROWS_AT_ONCE)
        own = part.column(id_column).to_numpy(zero_copy_only=False)
        for at, x in _vectors(part, v_column):
            if x.shape[1] in blocks:
                r = Rows(own[at], x)
                for _, block in blocks[x.shape[1]]:
                    block.add(r)


def _with_floors(queries: DataFrame, rows: DataFrame, k: int, pilots: int) -> DataFrame:
    """Distinct queries (id, hash, floor, v); floor is at most the k-th best score, found among a bounded sample of rows."""
    spark = rows.sparkSession
    n = rows.count()
    # by a hash of the row's place, so that equal rows are not drawn together; at most twice the number reaches the driver
    draw = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1_000_003)) / 1_000_003
    held = rows.select("id", "v", draw.alias("p")).filter(F.col("p") < min(1.0, pilots / max(n, 1))).select("id", "v").limit(2 * pilots).toArrow().combine_chunks()
    shared = spark.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, QUERIES_AT_ONCE):
                part = batch.slice(lo, QUERIES_AT_ONCE)
                floor = np.full(part.num_rows, -np.inf)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                for at, x in _vectors(part, 2):
                    block = Block(ids[at], x, k)
                    for pilot in shared.value.to_batches():
                        _feed({x.shape[1]: [(ids[at], block)]}, pilot, 0, 1)
                    # one part in 10^15 below, as a double may lie above the integer
                    floor[at] = block.least - np.abs(block.least) * 1e-15 if len(at) else block.least
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.where(np.isnan(floor), -np.inf, floor)), part.column(2)], ["id", "hash", "floor", "v"])

    distinct = queries.select("id", "v").distinct().select("id", F.xxhash64("v").alias("hash"), "v")
    return distinct.mapInArrow(run, "id long, hash long, floor double, v array<double>")


def top_k(queries: DataFrame, rows: DataFrame, k: int = 10, broadcast_bytes: int = 32 << 20, group_bytes: int = 64 << 20, pilots: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score for (id, v) queries against (id, v) rows; v holds whole doubles, as of quantize."""
    spark = rows.sparkSession
    ship(spark)
    asked = _with_floors(queries, rows, k, pilots)
    size = lambda df: df.agg(F.coalesce(F.sum(F.size("v") * 8 + 32), F.lit(0))).first()[0]
    if size(queries) <= broadcast_bytes:
        shared = spark.sparkContext.broadcast(asked.toArrow())

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = _blocks(shared.value, k)
            for batch in batches:
                _feed(blocks, batch, 0, 1)
            for held in blocks.values():
                yield from _found(held)

        out = rows.select("id", "v").mapInArrow(scan, RESULT)
    else:
        groups = max(1, -(-size(rows) // group_bytes))
        # by place, not by value: equal rows are spread, and every group holds as many
        dealt = rows.select(F.pmod(F.monotonically_increasing_id(), F.lit(groups)).cast("int").alias("g"), F.lit(0).alias("kind"), "id", F.lit(0).cast("long").alias("hash"), F.lit(0.0).alias("floor"), "v")
        sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(1).alias("kind"), "id", "hash", "floor", "v")

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, []
            for batch in batches:
                g, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                cuts = [0, *(np.flatnonzero((np.diff(g) != 0) | (np.diff(kind) != 0)) + 1).tolist(), batch.num_rows]
                for a, z in zip(cuts, cuts[1:], strict=False):
                    if a == z:
                        continue
                    if g[a] != now:
                        now, held = g[a], []
                    part = batch.slice(a, z - a).select([2, 3, 4, 5])
                    if kind[a] == 0:
                        held.append(part)
                        continue
                    blocks = _blocks(part, k)
                    for own in held:
                        _feed(blocks, own, 0, 3)
                    for done in blocks.values():
                        yield from _found(done)

        out = dealt.unionByName(sent).repartition("g").sortWithinPartitions("g", "kind").mapInArrow(meet, RESULT)
    best = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), F.desc("key"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
