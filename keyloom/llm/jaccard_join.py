"""Operator 7, n-gram Jaccard join: exact, by a universe partition and the pigeonhole principle.

A document is its set of distinct 5-word shingles, as 64-bit hashes. Sets of one size band share a partition of the hash
universe into m segments. Two sets that link (Jaccard at least 0.8) differ in at most H elements, H known from their sizes,
so they agree exactly on all but H segments. Each set is indexed once for every non-empty segment by a hash of the subset
that falls into it. A fixed rule decides the allocation: in the bands of the smallest sets, and for sets with so many empty
segments that the guarantee would rest on those, the one-deletion neighbourhoods of the subsets are indexed as well (a
segment then counts twice). A shared segment of either set is enough, so only pairs that both lack the guarantee are left; such
sets are also indexed by the first of their elements in hash order, as many as two linked sets must have one in common of.
Elsewhere m exceeds H + 1 by a slack, which pays for empty segments and for skipping hot ones.

Candidates. Index entries travel as packed blobs (8 bytes an entry), dealt out by hash. A bucket of at most `SMALL` sets
gives its pairs. A larger one gives only a star to its smallest member; a set none of whose links can hide behind its
large buckets, by its slack, needs no more. For the others, large buckets whose members are still in different components
give a star to their busiest member, and the sets around one such member are compared among themselves: in one task up to
a bound, beyond it by a join of their differences from that member (see `_around_heads`). Groups of copies never expand
into pairs of rows.

Candidate edges first pass an exact filter: the parity sketches of two sets differ in no more bits than the sets do in
elements, so a pair whose sketches differ in more than (|x| + |y|) / 9 bits cannot link. Verification is exact on whole
sets: candidate edges are grouped by their smaller end (hot ends salted), whose set is read
once, with the other ends streaming past. A first round takes each set's best edge, later rounds only edges between
different components. Components grow by contraction (hook to the smallest neighbour, then jump pointers), all in tables.
Equal sets are one node from the start. Nothing is capped or sampled.

Defined cases: null or empty texts and texts without words have no shingles and link with nothing; one to four words are
one shingle; repeated rows are copies; rows with a null id link only with equal sets; columns other than id and text are not
read, so clashing names do no harm; empty tables give empty results. Two different sets would only be taken for one if their 64-bit fingerprints met.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.bytescan import flat, slices
from keyloom.llm.common import discard, give_back, join_hot, scratch, ship, spread, stored, tables

SMALL = 8
KEY_BITS, MEMBER_BITS = 44, 20
PIECE = 1 << 20
TEXT_BYTES = 2 << 20  # shingled at once: their arrays take some twenty times as much
BROADCAST_BYTES = 64 << 20
SALT_ROWS = 4096
GROUP_ROWS = 1024
SENT_BYTES = 4 << 20
U = np.uint64

_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_fold = np.arange(256)
_fold[65:91] += 32
_values = (np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1))[_fold]
_BASE = 0x9E3779B97F4A7C15
_grown: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept and grown as needed."""
    if "up" not in _grown or len(_grown["up"]) < n:
        size = max(n, PIECE)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _grown[name] = np.cumprod(x)
    return _grown["up"], _grown["down"]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    h = (h ^ U(salt * 0xD6E8FEB86659FD93 % (1 << 64))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(31))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(29))


def word_hashes(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every word. Texts lie side by side in body."""
    owner, out = [], []
    n = len(offsets) - 1
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PIECE, "right")) - 1)
        a, z = int(offsets[lo]), int(offsets[hi])
        at = a
        while at < z:
            end = z
            if z - at > PIECE and hi == lo + 1:  # a long text is cut after white space
                gap = np.flatnonzero(_space[body[at : at + PIECE]])
                if len(gap):
                    end = at + int(gap[-1]) + 1
                else:
                    step = at + PIECE
                    while step < z and not _space[body[step : step + PIECE]].any():
                        step += PIECE
                    gap = np.flatnonzero(_space[body[step : step + PIECE]])
                    end = step + int(gap[0]) + 1 if len(gap) else z
            part = body[at:end]
            word = ~_space[part]
            first, last = word.copy(), word.copy()
            first[1:] &= ~word[:-1]
            last[:-1] &= ~word[1:]
            borders = offsets[lo + 1 : hi] - at
            borders = borders[(borders > 0) & (borders < len(part))]
            first[borders] = word[borders]
            last[borders - 1] = word[borders - 1]
            i, j = np.flatnonzero(first), np.flatnonzero(last) + 1
            up, down = _powers(len(part) + 1)
            sums = np.empty(len(part) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_values[part] * up[: len(part)], out=sums[1:])
            out.append(mix((sums[j] - sums[i]) * down[i], 1))
            owner.append(np.searchsorted(offsets, i + at, "right") - 1)
            at = end
        lo = hi
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(owner), np.concatenate(out)


def shingle_sets(body: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    n = len(offsets) - 1
    owner, h = word_hashes(body, offsets)
    count = np.bincount(owner, minlength=n)
    start = np.cumsum(count) - count
    sets = []
    rolled = np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for k in range(width):
        rolled = rolled * U(_BASE) + h[k : k + len(rolled)]
    rolled = mix(rolled, 2)
    for s, c in zip(start.tolist(), count.tolist(), strict=True):
        if c >= width:
            sets.append(np.unique(rolled[s : s + c - width + 1]))
        elif c:
            one = np.zeros(1, np.uint64)
            for x in h[s : s + c]:
                one = one * U(_BASE) + x
            sets.append(mix(one, 100 + c))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def fingerprint(s: np.ndarray) -> int:
    """A set's node id, a signed 64-bit integer."""
    return int(mix(np.array([mix(s, 3).sum(dtype=np.uint64) + U(len(s))], np.uint64), 4).view(np.int64)[0])


def odd_sketch(s: np.ndarray) -> bytes:
    """Parities of the set's elements over a power of two of at least 2 bits an element. Two sketches differ in no more bits than the sets in elements."""
    bits = 64
    while bits < 2 * len(s):
        bits *= 2
    at = (mix(s, 9) & U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


_ones = np.array([bin(i).count("1") for i in range(256)], np.int64)


def sketch_distance(x: bytes, y: bytes) -> int:
    """Bits that differ, the longer sketch folded to the shorter's size: a lower bound of the sets' difference."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(_ones[a ^ b].sum())


# bands ---------------------------------------------------------------------------------------------------------------


def band(k: int) -> tuple[int, int, int, bool]:
    """(smallest size, largest size, segments, one-deletion neighbourhoods for all) of band k. A set lies in one band or two; a linked pair shares one."""
    low, high = 1 << k, (5 << k) // 2
    most = 2 * high // 9
    if most <= 2:
        return low, high, -(-(most + 1) // 2), True
    return low, high, most + 1 + max(3, -(-18 * (most + 1) // 100)), False


def bands_of(n: int) -> list[int]:
    k = n.bit_length() - 1
    return [b for b in (k - 1, k) if b >= 1 and band(b)[0] <= n <= band(b)[1]]


def differences(n: np.ndarray, high: int) -> np.ndarray:
    """The most elements by which a set of n and a linked one of its band can differ."""
    return (n + np.minimum(high, 5 * n // 4)) // 9


def index_entries(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, member) of all entries; (set number, band and slack left) of each member, one for a set and band. Packed: band << 16 | slack + 1; slack -1: no guarantee but by large buckets."""
    keys, members, owner, slack = [], [], [], []
    by_band: dict[int, list[int]] = {}
    for i, s in enumerate(sets):
        for k in bands_of(len(s)) if len(s) else ():
            by_band.setdefault(k, []).append(i)
    used = 0
    for k, own in sorted(by_band.items()):
        _, high, m, always = band(k)
        size = np.array([len(sets[i]) for i in own])
        h = np.concatenate([sets[i] for i in own])
        of = np.repeat(np.arange(len(own)), size)
        seg = ((h >> U(32)) * U(m)) >> U(32)
        v = mix(h, 5)
        fresh = np.ones(len(h), bool)
        fresh[1:] = (seg[1:] != seg[:-1]) | (of[1:] != of[:-1])
        start = np.flatnonzero(fresh)
        count = np.diff(np.append(start, len(h)))
        place = seg[start] * U(0xA24BAED4963EE407) + U((k + 1) * 0x9FB21C651E98DF25 % (1 << 64))
        total = np.add.reduceat(v, start)
        keys.append(mix(total + place, 6))
        members.append(of[start] + used)
        filled = np.bincount(of[start], minlength=len(own))
        twice = np.bincount(of[start], count >= 2, len(own)).astype(np.int64)
        most = differences(size, high)
        left = filled - most - 1
        near = np.full(len(own), always) | (left < 0)
        if near.any():
            run = np.repeat(np.arange(len(start)), count)
            pick = near[of] & (count[run] >= 2)
            keys.append(mix(total[run[pick]] - v[pick] + place[run[pick]], 6))
            members.append(of[pick] + used)
            for i in np.flatnonzero(near & (filled + twice < most + 1)).tolist():
                # linked sets share at least 80 % of either: one of the first n - ceil(0.8 n) + 1 elements
                first = sets[own[i]][: int(size[i]) - (80 * int(size[i]) + 99) // 100 + 1]
                keys.append(mix(first + U(k * 0x9FB21C651E98DF25 % (1 << 64)), 7))
                members.append(np.full(len(first), i + used))
        owner.append(np.array(own))
        slack.append(k << 16 | (np.where(near, -1, np.minimum(left, 30000)) + 1))
        used += len(own)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(members), np.concatenate(owner), np.concatenate(slack)


def _id_hashes(ids: pa.Array) -> np.ndarray:
    if pa.types.is_integer(ids.type):
        return ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
    return np.array([zlib.crc32(str(i).encode()) for i in ids.to_pylist()], np.uint64)


# map and reduce ------------------------------------------------------------------------------------------------------


def _mapped(parts: int, id_type: pa.DataType, width: int):
    schema = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("id", id_type), ("a", pa.int64()), ("b", pa.int64()), ("entries", pa.binary()), ("nodes", pa.binary()), ("slack", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, TEXT_BYTES):
                sets = shingle_sets(*flat(part.column(1)), width)
                node = np.array([fingerprint(s) for s in sets], np.int64)
                n = np.array([len(s) for s in sets], np.int64)
                rows = len(sets)
                # documents are dealt by id, so that copies do not meet
                where = (mix(_id_hashes(part.column(0)), 8) >> U(32)).astype(np.int64) % parts
                none = pa.nulls(rows, pa.binary())
                sketches = pa.array([odd_sketch(s) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(rows, np.int32)), pa.array(where.astype(np.int32)), part.column(0), pa.array(node), pa.array(n), sketches, none, none], schema=schema)
                named = np.flatnonzero(part.column(0).is_valid().to_numpy(zero_copy_only=False))
                one = named[np.unique(node[named], return_index=True)[1]]
                keys, member, owner, slack = index_entries([sets[i] for i in one])
                names = node[one][owner] if len(owner) else node[:0]
                to = ((keys >> U(KEY_BITS)) * U(parts)) >> U(64 - KEY_BITS)
                order = np.argsort(to, kind="stable")
                to, keys, member = to[order], keys[order] & U((1 << KEY_BITS) - 1), member[order]
                cut = np.searchsorted(to, np.arange(parts + 1))
                out: list[list] = [[], [], [], []]
                held = 0
                for p in range(parts):
                    a, z = cut[p], cut[p + 1]
                    if a == z:
                        continue
                    seen, local = np.unique(member[a:z], return_inverse=True)
                    out[0].append(p)
                    out[1].append(((keys[a:z] << U(MEMBER_BITS)) | local.astype(np.uint64)).tobytes())
                    out[2].append(names[seen].tobytes())
                    out[3].append(slack[seen].astype(np.int32).tobytes())
                    held += len(out[1][-1])
                    if held > 1 << 23:
                        yield _blobs(out, schema, id_type)
                        out, held = [[], [], [], []], 0
                if out[0]:
                    yield _blobs(out, schema, id_type)
        give_back()

    return run


def _blobs(out: list[list], schema: pa.Schema, id_type: pa.DataType) -> pa.RecordBatch:
    n = len(out[0])
    none = pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.array(out[0], pa.int32()), pa.nulls(n, id_type), none, none, *(pa.array(x, pa.binary()) for x in out[1:])], schema=schema)


def bucket_edges(key: np.ndarray, node: np.ndarray, slack: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Edges (a < b, shared keys), and members of large buckets (key, node, the bucket's size above the member's band and slack)."""
    order = np.lexsort((node, key))
    key, node, slack = key[order], node[order], slack[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node, slack = key[fresh], node[fresh], slack[fresh]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(key)))
    a, b = [], []
    for s in range(2, SMALL + 1):
        rows = start[size == s]
        for i in range(s):
            for j in range(i + 1, s):
                a.append(node[rows + i])
                b.append(node[rows + j])
    large = size > SMALL
    inside = np.repeat(large, size)
    star = inside.copy()
    star[start[large]] = False
    a.append(np.repeat(node[start], size)[star])
    b.append(node[star])
    x, y = np.concatenate(a), np.concatenate(b)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    first = np.ones(len(x), bool)
    first[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    at = np.flatnonzero(first)
    return (x[at], y[at], np.diff(np.append(at, len(x)))), (key[inside], node[inside], np.repeat(size, size)[inside] << 32 | slack[inside].astype(np.int64))


def _reduced(id_type: pa.DataType):
    names = ["kind", "id", "a", "b", "c", "sketch"]

    def rows(kind: int, a, b, c, ids=None) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(a), 100_000):
            s = slice(at, at + 100_000)
            n = len(a[s])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.nulls(n, id_type) if ids is None else ids, pa.array(a[s]), pa.array(b[s]), pa.array(np.asarray(c[s], np.int64)), pa.nulls(n, pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            kind = batch.column(0).to_numpy(zero_copy_only=False)
            docs = np.flatnonzero(kind == 0)
            if len(docs):
                d = batch.take(pa.array(docs))
                yield pa.RecordBatch.from_arrays([d.column(0), d.column(2), d.column(3), d.column(4), pa.array(np.zeros(len(docs), np.int64)), d.column(5)], names)
            for i in np.flatnonzero(kind == 1).tolist():
                e = np.frombuffer(batch.column(5)[i].as_buffer(), np.uint64)
                local = (e & U((1 << MEMBER_BITS) - 1)).astype(np.int64)
                node = np.frombuffer(batch.column(6)[i].as_buffer(), np.int64)
                slack = np.frombuffer(batch.column(7)[i].as_buffer(), np.int32)
                held.setdefault(batch.column(1)[i].as_py(), []).append((e >> U(MEMBER_BITS), node[local], slack[local]))
        for p in sorted(held):
            key, node, slack = (np.concatenate(x) for x in zip(*held.pop(p), strict=True))
            (a, b, w), (key, node, slack) = bucket_edges(key, node, slack)
            yield from rows(1, a, b, w)
            yield from rows(2, key.astype(np.int64) | (np.int64(p) << KEY_BITS), node, slack)
        give_back()

    return run


def _possible(edges: DataFrame, sketches: DataFrame, folder: str, name: str) -> DataFrame:
    """Edges (a, b, ...) that their sketches (node, n, sketch) do not rule out, as table `name`. The edges of a hot end stay where they are."""
    kept = edges.columns
    edges = stored(edges, folder, f"{name}-raw")
    for x in "ab":
        edges = join_hot(edges, sketches.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")), x, f"end{x}")
    edges = edges.filter("sa is not null and sb is not null").select(*kept, "na", "nb", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(kept)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                na, nb = (batch.column(k + i).to_numpy(zero_copy_only=False) for i in (0, 1))
                sa, sb = batch.column(k + 2).to_pylist(), batch.column(k + 3).to_pylist()
                ok = [9 * sketch_distance(x, y) <= n for x, y, n in zip(sa, sb, (na + nb).tolist(), strict=True)]
                yield batch.filter(pa.array(ok, pa.bool_())).select(kept)
        give_back()

    from pyspark.sql.types import StructType

    out = stored(edges.mapInArrow(run, StructType([edges.schema[c] for c in kept])), folder, name)
    discard(edges.sparkSession, folder, f"{name}-raw")
    return out


# verification and components -------------------------------------------------------------------------------------------


def _sets_by_head(docs: DataFrame, members: DataFrame, edges: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(a, salt, role, tag, salts, node, shingles) for edges (a, b[, tag]): each head's set (role 0) comes before the sets at its edges' other ends (role 1). Hot heads are dealt out by salt."""
    edges = edges if "tag" in edges.columns else edges.withColumn("tag", F.lit(0).cast("long"))
    width_of = edges.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("salts"))
    salted = join_hot(edges, width_of, "a", "head").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    ends = salted.select(F.col("b").alias("node"), "a", "salt", F.lit(1).alias("role"), "tag", "salts")
    heads = width_of.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.lit(0).cast("long").alias("tag"), "salts")
    targets = ends.unionByName(heads).groupBy("node").agg(F.collect_list(F.struct("a", "salt", "role", "tag", "salts")).alias("targets"))
    # any one document of a node stands for its set
    wanted = targets.join(members.filter(F.col("id").isNotNull()).groupBy("node").agg(F.min("id").alias("id")), "node").select(F.col("id").alias("__id"), "node", "targets")
    wanted = stored(wanted, scratch(docs.sparkSession), "wanted")
    held = F.lit(64) + F.size("targets") * 64 + (F.octet_length("__id") if wanted.schema["__id"].dataType.typeName() in ("string", "binary") else F.lit(0))
    few = (wanted.agg(F.sum(held.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(wanted) if few else wanted, "__id").select("__text", "node", "targets")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, TEXT_BYTES):
                sets = shingle_sets(*flat(part.column(0)), width)
                # another text may have the same id
                true = np.array([fingerprint(s) for s in sets], np.int64) == part.column(1).to_numpy(zero_copy_only=False)
                if not true.all():
                    part, sets = part.filter(pa.array(true)), [s for s, t in zip(sets, true, strict=True) if t]
                lists = part.column(2)
                own = np.repeat(np.arange(len(sets)), np.asarray(lists.value_lengths()))
                flat_t = lists.flatten()
                blobs = pa.array([s.tobytes() for s in sets], pa.binary())
                sent_bytes = np.cumsum(np.array([s.nbytes for s in sets], np.int64)[own]) if len(own) else np.zeros(0, np.int64)
                lo = 0
                while lo < len(own):
                    hi = max(lo + 1, min(lo + 2000, int(np.searchsorted(sent_bytes, (sent_bytes[lo - 1] if lo else 0) + SENT_BYTES, "right"))))
                    k = pa.array(own[lo:hi])
                    t = flat_t.slice(lo, len(k))
                    lo = hi
                    yield pa.RecordBatch.from_arrays([t.field("a"), t.field("salt"), t.field("role"), t.field("tag"), t.field("salts"), part.column(1).take(k), blobs.take(k)], ["a", "salt", "role", "tag", "salts", "node", "shingles"])
        give_back()

    sent = texts.mapInArrow(emit, "a long, salt int, role int, tag long, salts int, node long, shingles binary")
    return sent.repartition("a", "salt").sortWithinPartitions("a", "salt", "role")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, int, np.ndarray, np.ndarray]]:
    """(head, node, tag, salts of the head, head's set, node's set) for each edge of _sets_by_head's rows; one head's set is held at a time."""
    now, head = None, np.zeros(0, np.uint64)
    for batch in batches:
        a, salt, role, tag, salts, node = (batch.column(i).to_numpy(zero_copy_only=False).tolist() for i in range(6))
        blobs = batch.column(6)
        for i in range(len(a)):
            s = np.frombuffer(blobs[i].as_buffer(), np.uint64)
            if role[i] == 0:
                now, head = (a[i], salt[i]), s.copy()
            elif now == (a[i], salt[i]):
                yield a[i], node[i], tag[i], salts[i], head, s
            else:
                raise RuntimeError("a set arrived without its head's")


def _verified(docs: DataFrame, members: DataFrame, edges: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """The edges (a, b) whose sets link. members: (id, node)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for head, node, _, _, x, y in _met(batches):
            both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
            if 100 * both >= 80 * (len(x) + len(y) - both):
                a.append(head)
                b.append(node)
            if len(a) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _sets_by_head(docs, members, edges, id_col, text_col, width).mapInArrow(compare, "a long, b long").distinct()


def _family_links(family: list[tuple[int, int, np.ndarray]]) -> tuple[list[int], list[int]]:
    """Linked pairs of different components among (node, component, set): all intersections at once, by a product over the elements that occur twice."""
    node, comp = (np.array([m[i] for m in family], np.int64) for i in (0, 1))
    n = np.array([len(m[2]) for m in family], np.int64)
    names, which, count = np.unique(np.concatenate([m[2] for m in family]), return_inverse=True, return_counts=True)
    own = np.repeat(np.arange(len(family)), n)
    column = np.cumsum(count > 1) - 1
    keep = count[which] > 1
    own, at = own[keep], column[which[keep]]
    order = np.argsort(at, kind="stable")
    own, at = own[order], at[order]
    both = np.zeros((len(family), len(family)), np.float32)
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, 1024):
        i, j = np.searchsorted(at, [lo, lo + 1024])
        part = np.zeros((len(family), 1024), np.float32)
        part[own[i:j], at[i:j] - lo] = 1
        both += part @ part.T
    both = both.astype(np.int64)
    x, y = np.nonzero(np.triu(100 * both >= 80 * (n[:, None] + n[None, :] - both), 1) & (comp[:, None] != comp[None, :]))
    x, y = node[x], node[y]
    return np.minimum(x, y).tolist(), np.maximum(x, y).tolist()


def _around_heads(docs: DataFrame, members: DataFrame, edges: DataFrame, id_col: str, text_col: str, width: int, family_rows: int = SALT_ROWS // 2, family_bytes: int = 48 << 20, group_rows: int = GROUP_ROWS) -> tuple[DataFrame, DataFrame]:
    """(links, candidate pairs) among the sets around each head. edges: (a, b, tag), tag the component of b.

    A family of bounded size is compared in one task and gives its links. The sets of a larger one never meet in one task:
    they are joined by their differences from the head. With D(x) the difference of x from the head, the difference of x
    and y is that of D(x) and D(y). A linked pair thus needs an overlap of D(x) and D(y) of at least t, half of |D(x)| +
    |D(y)| - (|x| + |y|) / 9 (if that isn't positive, both link to the head). In any one order of elements, the first common
    element then lies among the first |D| - t + 1 of both. The order puts what a set adds to its head before what it lacks:
    copies lack the same elements often, but their own edits are rare. Elements beyond what any partner can need are not
    even sent.
    """

    def entries(head: int, x: np.ndarray, family: list[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for node, tag, y in family:
            added = y[x[np.minimum(np.searchsorted(x, y), len(x) - 1)] != y]
            lacking = x[y[np.minimum(np.searchsorted(y, x), len(y) - 1)] != x]
            d = np.concatenate([added, lacking])
            far = (len(y) + 5 * len(y) // 4) // 9
            some = d[: len(d) - max(1, len(d) - far) + 1].view(np.int64)
            same = [np.full(len(some), v, np.int64) for v in (head, node, tag, len(d), len(y))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (same[0], some, same[1], same[2], same[3], same[4], np.arange(len(some)))], names)

    def links(head: int, family: list[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if len({m[1] for m in family}) > 1:
            a, b = _family_links(family)
            zero = pa.array(np.zeros(len(a), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.nulls(len(a), pa.int64()), pa.array(b, pa.int64()), zero, zero, zero, zero], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, x, family, held, large = None, np.zeros(0, np.uint64), [], 0, False
        for head, node, tag, salts, top, y in _met(batches):
            if head != now:
                if family:
                    yield from entries(now, x, family) if large else links(now, family)
                now, x, family, held, large = head, top, [], 0, salts > 1
            family.append((node, tag, y.copy()))
            held += y.nbytes
            if large or len(family) > family_rows or held > family_bytes:
                yield from entries(head, x, family)
                family, held, large = [], 0, True
        if family:
            yield from entries(now, x, family) if large else links(now, family)

    names = ["a", "element", "node", "comp", "size", "n", "pos"]
    found = _sets_by_head(docs, members, edges, id_col, text_col, width).mapInArrow(run, ", ".join(f"{c} long" for c in names))
    found = stored(found, scratch(docs.sparkSession), "families")
    sure = found.filter("element is null").select("a", F.col("node").alias("b")).distinct()
    sent = found.filter("element is not null")

    return sure, _meeting(sent, group_rows)


def _meeting(sent: DataFrame, group_rows: int) -> DataFrame:
    """Candidate pairs (a, b) among entries (a, element, node, comp, size, n, pos) of one head and element.

    A group of more than `group_rows` entries never meets in one task: it is dealt into parts of about that size, and each two
    parts meet in a task of their own, which holds one part and streams the other.
    """
    per = sent.groupBy("a", "element").agg(F.count(F.lit(1)).alias("k"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    # large groups are at most a group_rows-th of the entries; small ones take one part each
    large = per.filter((F.col("k") > group_rows) & (F.col("lo") != F.col("hi"))).select("a", "element", F.ceil(F.col("k") / group_rows).cast("int").alias("parts"))
    some = large.count()
    large = F.broadcast(large) if some * 48 <= BROADCAST_BYTES else large
    dealt = sent.join(large, ["a", "element"], "left") if some else sent.withColumn("parts", F.lit(None).cast("int"))
    parts = F.coalesce("parts", F.lit(1))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.select("a", "element", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "comp", "size", "n", "pos")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: np.ndarray | None = None
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(10)])
            rows = rows if tail is None else np.concatenate([tail, rows], 1)
            fresh = np.flatnonzero((rows[:4, 1:] != rows[:4, :-1]).any(0)) + 1
            cut = int(fresh[-1]) if len(fresh) else 0
            tail = rows[:, cut:]
            yield from _pairs(rows[:, :cut])
        if tail is not None:
            yield from _pairs(tail)

    dealt = dealt.repartition("a", "element", "i", "j").sortWithinPartitions("a", "element", "i", "j", "own")
    return dealt.mapInArrow(meet, "a long, b long").distinct()


def _pairs(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs of entries of one element (and of two parts of its group) that pass the position filter; rows are sorted by head, element and parts."""
    if not rows.shape[1]:
        return
    start = np.flatnonzero(np.concatenate([[True], (rows[:4, 1:] != rows[:4, :-1]).any(0)]))
    size = np.diff(np.append(start, rows.shape[1]))
    for s, k in zip(start[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        i, j = rows[2:4, s]
        own, node, comp, d, n, pos = rows[4:, s : s + k]
        # one part against itself, or the first part's entries against the other's
        first = k if i == j else int((own == i).sum())
        for p in range(0, first, 512):
            left = slice(p, min(p + 512, first))
            for q in range(p if i == j else first, k, 4096):
                right = slice(q, q + 4096)
                twice = d[left, None] + d[None, right] - (n[left, None] + n[None, right]) // 9
                t = (twice + 1) // 2
                ok = (comp[left, None] != comp[None, right]) & (t > 0) & (pos[left, None] <= d[left, None] - t) & (pos[None, right] <= d[None, right] - t)
                x, y = np.nonzero(ok)
                x, y = node[left][x], node[right][y]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])


def components(links: DataFrame, folder: str, name: str) -> DataFrame:
    """(node, comp) for every node of links (a, b): comp is the smallest node reachable. Contraction by hooking and pointer jumping."""
    edges = stored(links.select("a", "b").distinct(), folder, f"{name}-edges0")
    labels = None
    turn = 0
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("comp")), folder, f"{name}-parent{turn}")
        jump = 0
        while True:
            up = parent.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
            parent = stored(parent.join(up, "comp").select("node", F.col("top").alias("comp"), (F.col("top") != F.col("comp")).alias("moved")), folder, f"{name}-parent{turn}-{jump}")
            jump += 1
            if not parent.filter("moved").limit(1).count():
                break
        parent = parent.drop("moved")
        old = parent if labels is None else labels.join(parent.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
        labels = stored(old, folder, f"{name}-labels{turn}")
        a, b = (parent.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
        moved = edges.join(a, "a").join(b, "b").filter("ca != cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
        turn += 1
        edges = stored(moved, folder, f"{name}-edges{turn}")
        if not edges.limit(1).count():
            return labels


def link_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, bytes_per_part: int = 8 << 20, family_rows: int = SALT_ROWS // 2, group_rows: int = GROUP_ROWS) -> DataFrame:
    """id, n_shingles and component_id (the smallest id reachable by links) of every row of df."""
    spark = df.sparkSession
    ship(spark)
    folder = scratch(spark)
    total = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bytes_per_part)))
    id_field = df.schema[id_col].dataType
    kind = id_field.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(id_field)
    mapped = spread(df.select(id_col, text_col)).mapInArrow(_mapped(parts, id_type, width), f"kind int, part int, id {kind}, a long, b long, entries binary, nodes binary, slack binary")
    reduced = mapped.repartition(parts, "part").mapInArrow(_reduced(id_type), f"kind int, id {kind}, a long, b long, c long, sketch binary")
    reduced.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/index")
    index = spark.read.schema(f"id {kind}, a long, b long, c long, sketch binary, kind int").parquet(f"{folder}/index")
    members = index.filter("kind = 0").select("id", F.col("a").alias("node"), F.col("b").alias("n"))
    sketches = stored(index.filter("kind = 0").groupBy(F.col("a").alias("node")).agg(F.first("b").alias("n"), F.first("sketch").alias("sketch")), folder, "sketches")
    edges = _possible(index.filter("kind = 1").groupBy("a", "b").agg(F.sum("c").alias("w")), sketches, folder, "edges")
    c = F.col("c")
    large = index.filter("kind = 2").select(F.col("a").alias("key"), F.col("b").alias("node"), F.shiftright(c, 32).alias("size"), F.shiftright(c, 16).bitwiseAND(0xFFFF).alias("band"), (c.bitwiseAND(0xFFFF) - 1).alias("slack"))

    # round one: every node's best edge to a smaller node
    best = edges.groupBy("b").agg(F.max_by("a", F.struct("w", F.bitwise_not("a"))).alias("a")).select("a", "b")
    links = stored(_verified(df, members, best, id_col, text_col, width), folder, "links1")
    comps = components(links, folder, "comps1")

    def across(pairs: DataFrame) -> DataFrame:
        """Pairs whose ends are in different components so far."""
        for x in "ab":
            pairs = pairs.join(comps.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")), x, "left")
        return pairs.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    # round two: the other edges, where they still matter
    rest = stored(across(edges.select("a", "b").join(best, ["a", "b"], "left_anti")), folder, "rest2")
    if rest.limit(1).count():
        links = links.union(stored(_verified(df, members, rest, id_col, text_col, width), folder, "links2"))
        comps = components(links, folder, "comps2")

    # round three: sets without a guarantee elsewhere, in large buckets that still span components
    # a set may skip as many of a band's keys as it has slack. All skip the largest buckets first, in one order: of the keys
    # that two linked sets share, the one last in that order is then skipped by neither
    of_band = Window.partitionBy("node", "band").orderBy(F.desc("size"), "key")
    busy = large.withColumn("rank", F.row_number().over(of_band)).filter("rank > slack").withColumn("hot", F.count(F.lit(1)).over(Window.partitionBy("node")))
    busy = busy.join(comps, "node", "left").select("key", "node", "hot", F.coalesce("comp", "node").alias("tag"))
    busy = stored(busy, folder, "busy3")
    head = F.max_by("node", F.struct("hot", "node"))
    heads = busy.groupBy("key").agg(head.alias("a"), F.min("tag").alias("lo"), F.max("tag").alias("hi")).filter("lo != hi").select("key", "a")
    # a bucket's members meet its head: a hot bucket's rows stay where they are
    spokes = stored(join_hot(busy, heads, "key", "head").filter("a is not null and node != a").select("a", F.col("node").alias("b")).distinct(), folder, "spokes3")
    if spokes.limit(1).count():
        # once more a star, now to the busiest set, which copies with many edits are more likely to link to
        ordered = spokes.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(edges, ["a", "b"], "left_anti")
        star = _possible(across(ordered), sketches, folder, "star3")
        links = links.union(stored(_verified(df, members, star, id_col, text_col, width), folder, "links3"))
        comps = components(links, folder, "comps3")
        tagged = spokes.join(comps.select(F.col("node").alias("b"), F.col("comp").alias("tag")), "b", "left").withColumn("tag", F.coalesce("tag", "b"))
        mixed = tagged.groupBy("a").agg(F.min("tag").alias("lo"), F.max("tag").alias("hi")).filter("lo != hi").select("a")
        spokes = stored(tagged.join(mixed, "a").select("a", "b", "tag"), folder, "spokes4")
    if spokes.limit(1).count():
        sure, pairs = _around_heads(df, members, spokes, id_col, text_col, width, family_rows, group_rows=group_rows)
        pairs = _possible(pairs, sketches, folder, "pairs4")
        links = links.union(sure).union(stored(_verified(df, members, pairs, id_col, text_col, width), folder, "links4"))
        # the heads' own edges were all verified above, or in an earlier round
        comps = components(links, folder, "comps4")

    # classes are found by node, where a group of equal sets is one row; only then do documents meet their node's class
    nodes = members.filter("n > 0").groupBy("node").agg(F.min("id").alias("low"))
    nodes = stored(nodes.join(comps, "node", "left").select("node", "low", F.coalesce("comp", "node").alias("class")), folder, "nodes")
    smallest = stored(nodes.groupBy("class").agg(F.min("low").alias("least")), folder, "smallest")
    named = stored(join_hot(nodes, smallest, "class", "class").select("node", "least"), folder, "named")
    keyed = members.select("id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node"))
    out = stored(join_hot(keyed, named, "node", "node").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id")), folder, "result")
    discard(spark, folder, *(n for n in tables(spark, folder) if n != "result"))
    return out
