"""Text columns of Arrow batches as flat byte arrays, and reductions over them that keep memory bounded.

A batch's texts lie one after the other in a buffer; these helpers cut it into pieces of at most `limit` bytes (whole texts
where they fit, parts of a text with an overlap where one is longer), so temporary arrays never follow a text's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: int, limit: int, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most `rows` rows whose texts are at most about `limit` bytes together."""
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), np.int64)
    end = np.cumsum(size)
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(end, (end[lo - 1] if lo else 0) + limit, "right"))
        hi = min(max(hi, lo + 1), lo + rows, batch.num_rows)
        yield batch.slice(lo, hi - lo)
        lo = hi


def pieces(offsets: np.ndarray, limit: int, overlap: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of spans (text number, from, to) of at most about `limit` bytes together. Parts of one text overlap by `overlap` bytes."""
    doc: list[int] = []
    lo: list[int] = []
    hi: list[int] = []
    held = 0
    for i in range(len(offsets) - 1):
        a, end = int(offsets[i]), int(offsets[i + 1])
        while True:
            b = min(end, a + limit)
            if held and held + b - a > limit:
                yield np.array(doc), np.array(lo), np.array(hi)
                doc, lo, hi, held = [], [], [], 0
            doc.append(i)
            lo.append(a)
            hi.append(b)
            held += b - a
            if b == end:
                break
            a = b - overlap
    if doc:
        yield np.array(doc), np.array(lo), np.array(hi)


def span_sums(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sum of values[lo:hi] for each span; spans ascend and may be empty."""
    out = np.zeros(len(lo), np.float64)
    some = hi > lo
    if some.any():
        ends = np.stack([lo[some], hi[some]], 1).ravel()
        padded = np.append(values, values.dtype.type(0))
        out[some] = np.add.reduceat(padded, np.minimum(ends, len(values)))[::2]
    return out


def sample_by_label(df, label: str, key: str, text: str, per_label: int, max_bytes: int, seed: int) -> pa.Table:
    """A bounded sample for training on the driver: about per_label rows of each label, chosen by a hash of the key, without texts over max_bytes.

    At most 1.2 * per_label rows a label come back, so the driver holds no more than labels * 1.2 * per_label * max_bytes.
    """
    from pyspark.sql import functions as F

    fit = df.filter(F.col(label).isNotNull() & F.col(text).isNotNull() & (F.octet_length(text) <= max_bytes)).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).alias("label"))
    counts = {r["label"]: r["n"] for r in fit.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1_000_003)) / 1_000_003
    parts = [fit.filter((F.col("label") == v) & (draw < min(1.0, per_label / n))).limit(int(1.2 * per_label) + 1) for v, n in sorted(counts.items())]
    if not parts:
        return pa.table({"key": pa.array([], pa.int64()), "text": pa.array([], pa.string()), "label": pa.array([], pa.string())})
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    got = out.toArrow()
    return got.sort_by([("label", "ascending"), ("key", "ascending")])
