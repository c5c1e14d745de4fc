"""Operator 2, quality classifier: a byte-level convolutional network in numpy.

Each of `FILTERS` learned filters reads `WIDTH` bytes, those up to a place; as bytes are one-hot, a filter is a table of 256
weights for each of them and its response a sum of look-ups. Texts of a batch lie side by side with zero bytes between, as
many as a filter can read, and all sums run in one fixed order: a document's score depends on its own bytes alone, to the last bit,
whatever its batch holds. Responses are max-pooled over overlapping chunks of 256 bytes (a new one every
128) that cover the whole document. A hidden layer turns a chunk's pooled responses into a chunk vector, the chunk vectors
are max-pooled over the document, and a logistic unit combines them into one probability. Trained by Adam through the
pooling (gradients reach the places that won).

Training uses a bounded sample: about `per_label` documents a label, none over `max_bytes`, of which each round sees a
window of at most 2 KiB, sometimes a much shorter one, drawn alike for both labels. Scoring covers every byte of every document, in pieces of bounded memory.

Defined cases: null and empty texts are one chunk of padding and get its score; if only one label, or none, is seen, the
score is that label's (else 0.5); rows without a label are not learned from; repeated rows get equal scores; other columns
are never read, so names that clash with `score` do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from keyloom.llm.bytescan import flat, sample_by_label
from keyloom.llm.common import give_back, ship, spread

WIDTH, FILTERS, HIDDEN = 6, 16, 16
BLOCK, PER_CHUNK, STRIDE = 64, 4, 2  # chunk: 4 blocks; a new one every 2
BLOCKS_AT_ONCE = 2048


def layout(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of each text (with WIDTH - 1 zero bytes after it, and so that chunks fit without rest), chunks of each text, and the first block of each chunk."""
    blocks = np.maximum(-(-(sizes + WIDTH - 1) // BLOCK), PER_CHUNK)
    blocks += (blocks - PER_CHUNK) % STRIDE
    chunks = (blocks - PER_CHUNK) // STRIDE + 1
    start = np.cumsum(blocks) - blocks
    inner = np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    return blocks, chunks, np.repeat(start, chunks) + inner * STRIDE


def padded(body: np.ndarray, offsets: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """WIDTH - 1 zero bytes, then the texts, each from a block border on and with zero bytes behind: what the first places of a text read before it are zeros too."""
    out = np.zeros(int(blocks.sum()) * BLOCK + WIDTH - 1, np.uint8)
    start = (np.cumsum(blocks) - blocks) * BLOCK + WIDTH - 1
    for i, s in enumerate(start):
        a, b = offsets[i], offsets[i + 1]
        out[s : s + b - a] = body[a:b]
    return out


def product(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w, summed in one order whatever the number of rows."""
    out = x[:, 0, None] * w[0]
    for k in range(1, x.shape[1]):
        out += x[:, k, None] * w[k]
    return out


class Network:
    def __init__(self, seed: int = 2):
        r = np.random.default_rng(seed)
        self.p = {
            "filters": (r.normal(0, 0.3, (WIDTH, 256, FILTERS))).astype(np.float32),
            "w1": r.normal(0, 0.3, (FILTERS, HIDDEN)).astype(np.float32),
            "b1": np.zeros(HIDDEN, np.float32),
            "w2": r.normal(0, 0.3, HIDDEN).astype(np.float32),
            "b2": np.zeros(1, np.float32),
        }
        self.constant: float | None = None

    def responses(self, x: np.ndarray) -> np.ndarray:
        """(places, filters) for all runs of WIDTH bytes of x."""
        n = len(x) - WIDTH + 1
        out = self.p["filters"][0].take(x[:n], 0)
        for k in range(1, WIDTH):
            out += self.p["filters"][k].take(x[k : n + k], 0)
        return out

    def block_peaks(self, x: np.ndarray) -> np.ndarray:
        n = (len(x) - WIDTH + 1) // BLOCK
        out = np.empty((n, FILTERS), np.float32)
        for a in range(0, n, BLOCKS_AT_ONCE):
            z = min(n, a + BLOCKS_AT_ONCE)
            out[a:z] = self.responses(x[a * BLOCK : z * BLOCK + WIDTH - 1]).reshape(z - a, BLOCK, FILTERS).max(1)
        return out

    def score_texts(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if self.constant is not None or not n:
            return np.full(n, self.constant if self.constant is not None else 0.5)
        out = np.empty(n)
        # groups of texts of about 4 MB; a longer text is a group of its own, and its blocks are taken a few at a time
        for lo, hi in groups(offsets, 1 << 22):
            own = offsets[lo : hi + 1]
            blocks, chunks, first = layout(np.diff(own))
            peaks = self.block_peaks(padded(body, own, blocks))
            pooled = peaks[first]
            for k in range(1, PER_CHUNK):
                np.maximum(pooled, peaks[first + k], out=pooled)
            vectors = np.tanh(product(np.maximum(pooled, 0), self.p["w1"]) + self.p["b1"])
            best = np.maximum.reduceat(vectors, np.cumsum(chunks) - chunks)
            out[lo:hi] = 1 / (1 + np.exp(-np.clip(product(best, self.p["w2"][:, None])[:, 0] + self.p["b2"], -30, 30).astype(np.float64)))
        return out

    def fit(self, texts: list[bytes], labels: np.ndarray, rounds: int = 14, batch: int = 48, window: int = 2048, rate: float = 0.01, seed: int = 2) -> None:
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        classes = [np.flatnonzero(labels == c) for c in (0, 1)]
        per = max(len(c) for c in classes)
        for turn in range(rounds):
            order = r.permutation(np.concatenate([r.permutation(np.resize(c, per)) for c in classes]))
            lr = rate * (0.5 * (1 + np.cos(np.pi * turn / rounds)) + 0.02)
            for a in range(0, len(order), batch):
                pick = order[a : a + batch]
                cut = []
                for i in pick:
                    t = texts[i]
                    # now and then a short cut, so that short texts are not foreign
                    size = window if r.random() < 0.96 else int(np.exp(r.uniform(np.log(8), np.log(100))))
                    at = int(r.integers(0, len(t) - size + 1)) if len(t) > size else 0
                    cut.append(t[at : at + size])
                grads = self._gradients(cut, labels[pick])
                step += 1
                for k, g in grads.items():
                    g = g + 1e-4 * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)

    def _gradients(self, texts: list[bytes], y: np.ndarray) -> dict[str, np.ndarray]:
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        blocks, chunks, first = layout(np.diff(offsets))
        x = padded(np.frombuffer(b"".join(texts), np.uint8), offsets, blocks)
        resp = self.responses(x).reshape(-1, BLOCK, FILTERS)
        where = resp.argmax(1)
        peaks = np.take_along_axis(resp, where[:, None], 1)[:, 0]
        stacked = np.stack([peaks[first + k] for k in range(PER_CHUNK)])
        which = stacked.argmax(0)
        pooled = np.take_along_axis(stacked, which[None], 0)[0]
        act = np.maximum(pooled, 0)
        vec = np.tanh(act @ self.p["w1"] + self.p["b1"])
        starts = np.cumsum(chunks) - chunks
        won = np.stack([s + vec[s : s + c].argmax(0) for s, c in zip(starts, chunks, strict=True)])
        best = np.take_along_axis(vec, won, 0)
        p = 1 / (1 + np.exp(-np.clip(best @ self.p["w2"] + self.p["b2"], -30, 30)))
        d = ((p - y) / len(y)).astype(np.float32)
        g = {"w2": best.T @ d, "b2": d.sum(keepdims=True)}
        dvec = np.zeros_like(vec)
        np.add.at(dvec, (won, np.arange(HIDDEN)[None]), d[:, None] * self.p["w2"][None])
        dvec *= 1 - vec * vec
        g["w1"], g["b1"] = act.T @ dvec, dvec.sum(0)
        dact = (dvec @ self.p["w1"].T) * (pooled > 0)
        c, f = np.nonzero(dact)
        block = first[c] + which[c, f]
        place = block * BLOCK + where[block, f]
        g["filters"] = np.zeros_like(self.p["filters"])
        for k in range(WIDTH):
            np.add.at(g["filters"][k], (x[place + k], f), dact[c, f])
        return g


def groups(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    lo = 0
    n = len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def learn(df: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_label: int = 700, max_bytes: int = 1 << 15, seed: int = 2) -> Network:
    got = sample_by_label(df, label_col, id_col, text_col, per_label, max_bytes, seed)
    labels = np.array(got["label"].to_pylist(), np.float32)
    net = Network(seed)
    if not len(labels):
        net.constant = 0.5
    elif labels.min() == labels.max():
        net.constant = float(labels[0])
    else:
        net.fit([t.encode() for t in got["text"].to_pylist()], labels)
    return net


def score(df: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of each document."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(net)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score_texts(*flat(b.column(1))), pa.float64())], [id_col, "score"])
        give_back()

    return spread(df.select(id_col, text_col)).mapInArrow(run, schema)
