"""Operator 5, toxicity: a linear-chain conditional random field over the words of a document.

Words are runs of letters (A-Z lower-cased, non-ASCII bytes taken as letters). A word's features are its hash and the hashes
of its first 4 to 7 bytes, for inflected forms. Labels come for documents only, so tokens are labelled first: a feature
that `lift` times as large a share of toxic documents holds as of others, and enough of them, marks the words that have it
as toxic there. The field (two states; word features, bias, transitions) is fitted to these tokens by gradient ascent on
the conditional likelihood. For a document, forward-backward gives every word its marginal; the marginals make the document
score through a small logistic model, and words above one half give the offending byte spans.

Forward and backward messages forget at a known rate. Words without known features all have one emission, so between hits
the messages are at their fixed point to double precision; recursions run only over the words within `reach` of a hit, for
all documents of a batch at once. Documents begin and end as if neutral text lay around them.

Training uses a bounded sample: about `per_label` documents a label, none over `max_bytes`. All else covers all documents.

Defined cases: null and empty texts and texts without known words get the score of no evidence; rows without a label are
not learned from; if only one label, or none, is seen, the score is that label's (else 0); long texts are read whole, in
pieces; repeated rows get equal scores; columns other than id, text and (in training) the label are not read, so clashing
names do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.bytescan import flat, pieces, sample_by_label
from keyloom.llm.common import give_back, ship, spread

PREFIXES = (4, 5, 6, 7)
PIECE = 1 << 20
OVERLAP = 1 << 10
FILTER_BITS = 20

_lower = np.zeros(256, np.uint8)
_lower[97:123] = np.arange(97, 123)
_lower[65:91] = np.arange(97, 123)
_lower[128:] = np.arange(128, 256)
_values = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_up, _down = _powers(_BASE, PIECE + OVERLAP), _powers(_INVERSE, PIECE + OVERLAP)


def mix(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt * 0xD6E8FEB86659FD93 % (1 << 64))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def words(body: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, prefix sums) of the words in body; `hashes` turns byte ranges into hashes."""
    x = _lower[body]
    letter = np.empty(len(x) + 2, bool)
    letter[0] = letter[-1] = False
    np.not_equal(x, 0, out=letter[1:-1])
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    sums = np.empty(len(x) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_values[x] * _up[: len(x)], out=sums[1:])
    return edge[::2], edge[1::2], sums


def hashes(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray, salt: int) -> np.ndarray:
    return mix((sums[hi] - sums[lo]) * _down[lo], salt)


def feature_rows(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, hashes) for each kind of feature."""
    yield np.arange(len(lo)), hashes(sums, lo, hi, 1)
    for k in PREFIXES:
        some = np.flatnonzero(hi - lo >= k)
        yield some, hashes(sums, lo[some], lo[some] + k, k)


def document_words(body: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(document of each word, from, to, prefix sums, where the piece begins). Parts of a long document overlap; each word comes once, and whole if shorter than the overlap."""
    for doc, lo, hi in pieces(offsets, PIECE, overlap=OVERLAP):
        a, z = int(lo[0]), int(hi[-1])
        part = body[a:z]
        start, end, sums = words(part)
        if not len(start):
            continue
        # texts touch each other in the buffer: cut words at text ends
        cuts = np.unique((lo[1:] - a)[np.diff(doc) > 0])
        inside = cuts[np.searchsorted(start, cuts, "right") - 1 >= 0]
        at = np.searchsorted(start, inside, "right") - 1
        split = inside[(start[at] < inside) & (end[at] > inside)]
        if len(split):
            start, end = np.sort(np.concatenate([start, split])), np.sort(np.concatenate([end, split]))
        at = np.searchsorted(lo - a, start, "right") - 1
        # in a later part of the same text, what begins in the overlap was seen; in an earlier part, what reaches its cut end comes again
        more = np.append(doc[1:] == doc[:-1], False)
        first = np.insert(doc[1:] != doc[:-1], 0, True) & (lo == offsets[doc])
        seen = ~first[at] & (start < (lo - a)[at] + OVERLAP // 2)
        again = (more[at] | (hi[at] < offsets[doc[at] + 1])) & (start >= (hi - a)[at] - OVERLAP // 2)
        use = ~(seen | again)
        yield doc[at][use], start[use], end[use], sums, a


class Field:
    """Feature weights, bias and transitions; marginals of state 1."""

    def __init__(self, known: np.ndarray):
        self.known = known  # sorted hashes
        self.w = np.zeros(len(known))
        self.bias = -4.0
        self.t = np.array([[0.0, -1.0], [-1.0, 0.5]])
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[known >> np.uint64(64 - FILTER_BITS)] = True

    def look_up(self, sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers, feature numbers) of known features."""
        at, which = [], []
        for rows, h in feature_rows(sums, lo, hi):
            some = np.flatnonzero(self.filter[h >> np.uint64(64 - FILTER_BITS)])
            h = h[some]
            i = np.minimum(np.searchsorted(self.known, h), max(len(self.known) - 1, 0))
            hit = self.known[i] == h if len(self.known) else np.zeros(len(h), bool)
            at.append(rows[some[hit]])
            which.append(i[hit])
        return np.concatenate(at), np.concatenate(which)

    def fixed_points(self) -> tuple[float, float, float]:
        """Forward odds after, and backward odds before, endless neutral text; and the rate at which messages forget."""
        a, e = np.exp(self.t), np.exp(self.bias)
        r = s = 1.0
        for _ in range(2000):
            r = e * (a[0, 1] + a[1, 1] * r) / (a[0, 0] + a[1, 0] * r)
            u = e * s
            s = (a[1, 0] + a[1, 1] * u) / (a[0, 0] + a[0, 1] * u)
        values = np.abs(np.linalg.eigvals(a * np.array([[1.0, e]])))
        return r, s, float(values.min() / values.max())

    def odds(self, emission: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward odds for sequences in columns (steps, sequences), neutral text around them."""
        a = np.exp(self.t)
        r0, s0, _ = self.fixed_points()
        phi = np.exp(np.clip(emission, -40, 40))
        n = len(phi)
        r, s = np.empty_like(phi), np.empty_like(phi)
        prev = np.full(phi.shape[1], r0)
        for i in range(n):
            prev = r[i] = phi[i] * (a[0, 1] + a[1, 1] * prev) / (a[0, 0] + a[1, 0] * prev)
        later = np.full(phi.shape[1], s0)
        for i in range(n - 1, -1, -1):
            s[i] = later
            u = phi[i] * later
            later = (a[1, 0] + a[1, 1] * u) / (a[0, 0] + a[0, 1] * u)
        return r, s

    def fit(self, emission_rows: np.ndarray, which: np.ndarray, y: np.ndarray, steps: int = 128, rounds: int = 120, rate: float = 0.15, penalty: float = 1e-2) -> None:
        """Adam on the conditional log likelihood; words cut to sequences of `steps`. emission_rows, which: word and feature of each hit."""
        n = len(y)
        cols = max(1, -(-n // steps))
        full = np.zeros(cols * steps)
        full[:n] = y
        lab = full.reshape(cols, steps).T
        real = (np.arange(cols * steps) < n).reshape(cols, steps).T
        theta = np.concatenate([self.w, [self.bias], self.t.ravel()])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        k = len(self.w)
        want = np.array([[(lab[:-1] == i)[real[1:]] @ (lab[1:] == j)[real[1:]].astype(float) for j in (0, 1)] for i in (0, 1)])
        for step in range(1, rounds + 1):
            self.w, self.bias, self.t = theta[:k], float(theta[k]), theta[k + 1 :].reshape(2, 2)
            e = np.bincount(emission_rows, self.w[which], cols * steps) + self.bias
            e = e.reshape(cols, steps).T
            r, s = self.odds(e)
            p = r * s / (1 + r * s)
            a = np.exp(self.t)
            one, phi = np.ones_like(r[:-1]), np.exp(np.clip(e[1:], -40, 40))
            pair = np.array([[one * a[0, 0], a[0, 1] * phi * s[1:]], [r[:-1] * a[1, 0], r[:-1] * a[1, 1] * phi * s[1:]]])
            pair /= pair.sum((0, 1))
            got = (pair * real[1:]).sum((2, 3))
            err = ((lab - p) * real).T.ravel()
            grad = np.concatenate([np.bincount(which, err[emission_rows], k), [err.sum()], (want - got).ravel()]) - penalty * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            theta[k + 1 :] = np.clip(theta[k + 1 :], -4, 2)
        self.w, self.bias, self.t = theta[:k].copy(), float(theta[k]), theta[k + 1 :].reshape(2, 2).copy()

    def marginals(self, doc: np.ndarray, hit_rows: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers, marginals) of all words near a hit; words ascend by document and place."""
        if not len(hit_rows):
            return np.zeros(0, np.int64), np.zeros(0)
        n = len(doc)
        e = np.bincount(hit_rows, self.w[which], n) + self.bias
        rate = min(self.fixed_points()[2], 0.98)
        reach = int(np.ceil(np.log(1e-9) / np.log(max(rate, 1e-6)))) + 1
        hits = np.unique(hit_rows)
        first = np.searchsorted(doc, doc[hits], "left")
        last = np.searchsorted(doc, doc[hits], "right")
        lo, hi = np.maximum(hits - reach, first), np.minimum(hits + reach + 1, last)
        fresh = np.concatenate([[True], (lo[1:] > hi[:-1]) | (doc[hits[1:]] != doc[hits[:-1]])])
        run = np.flatnonzero(fresh)
        a, z = lo[run], np.maximum.reduceat(hi, run)
        # runs of any length are cut to pieces of 1024 words that see `reach` words more on either side
        size = 1024
        parts = np.maximum(-(-(z - a) // size), 1)
        own = np.repeat(np.arange(len(a)), parts)
        k = np.arange(len(own)) - np.repeat(np.cumsum(parts) - parts, parts)
        core_a = a[own] + k * size
        core_z = np.minimum(core_a + size, z[own])
        see_a, see_z = np.maximum(core_a - reach, a[own]), np.minimum(core_z + reach, z[own])
        out_rows, out_p = [], []
        order = np.argsort(see_z - see_a, kind="stable")
        for group in np.array_split(order, max(1, -(-len(order) // 512))):
            width = int((see_z - see_a)[group].max())
            grid = see_a[group][None, :] + np.arange(width)[:, None]
            valid = grid < see_z[group][None, :]
            r, s = self.odds(np.where(valid, e[np.minimum(grid, n - 1)], self.bias))
            p = r * s / (1 + r * s)
            core = (grid >= core_a[group][None, :]) & (grid < core_z[group][None, :])
            out_rows.append(grid[core])
            out_p.append(p[core])
        rows, p = np.concatenate(out_rows), np.concatenate(out_p)
        order = np.argsort(rows)
        return rows[order], p[order]


class Model:
    def __init__(self, texts: list[str], labels: list[int], rate: float | None = None, lift: float = 6.0, least_docs: int = 4):
        y = np.array(labels, np.float64)
        self.constant = None if 0 < y.sum() < len(y) else float(y[0]) if len(y) else 0.0
        if self.constant is not None:
            return
        body, offsets = flat(pa.array(texts, pa.large_string()))
        hs, owner, found = [], [], []
        for doc, lo, hi, sums, _ in document_words(body, offsets):
            found.append((doc, lo, hi, sums))
            for rows, h in feature_rows(sums, lo, hi):
                hs.append(h)
                owner.append(doc[rows])
        h, d = np.concatenate(hs), np.concatenate(owner)
        del hs, owner
        names, which = np.unique(h, return_inverse=True)
        del h
        pairs = np.unique(which * np.int64(len(texts)) + d)  # a document counts once for a feature, however often it repeats it
        toxic = y[pairs % len(texts)] > 0
        t, c = (np.bincount(pairs[side] // len(texts), minlength=len(names)) for side in (toxic, ~toxic))
        ratio = (t / y.sum()) / ((c + 0.5) / (len(y) - y.sum()))
        self.field = Field(names[(ratio >= lift) & (t >= max(least_docs, 0.015 * y.sum()))])
        del pairs, which, d, toxic
        rows, feats, lab, n = [], [], [], 0
        for doc, lo, hi, sums in found:
            at, f = self.field.look_up(sums, lo, hi)
            one = np.zeros(len(doc))
            one[at] = y[doc[at]]
            rows.append(at + n)
            feats.append(f)
            lab.append(one)
            n += len(doc)
        self.field.fit(np.concatenate(rows), np.concatenate(feats), np.concatenate(lab))
        # the document model: logistic in what the marginals say, weighted to the labels' natural rate
        x = self.evidence(body, offsets)[0]
        share = y.mean()
        weight = np.where(y > 0, (rate or share) / share, (1 - (rate or share)) / (1 - share))
        # a text without words, which the sample may lack, is known to be clean
        x, y, weight = np.vstack([x, np.zeros(x.shape[1])]), np.append(y, 0.0), np.append(weight, 5.0)
        self.low, self.high, self.mean, self.std = x.min(0), x.max(0), x.mean(0), x.std(0) + 1e-9
        z = np.column_stack([(x - self.mean) / self.std, np.ones(len(x))])
        self.beta = np.zeros(z.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ self.beta, -30, 30)))
            g = z.T @ (weight * (y - p)) - 1e-2 * self.beta
            hess = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(z.shape[1])
            self.beta = self.beta + np.linalg.solve(hess, g)

    def evidence(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[dict]]]:
        """Features of each document, and its offending spans."""
        n = len(offsets) - 1
        mass, peak, hot, count = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        spans: list[list[dict]] = [[] for _ in range(n)]
        for doc, lo, hi, sums, a in document_words(body, offsets):
            count += np.bincount(doc, minlength=n)
            rows, p = self.field.marginals(doc, *self.field.look_up(sums, lo, hi))
            if not len(rows):
                continue
            d = doc[rows]
            mass += np.bincount(d, -np.log1p(-np.minimum(p, 1 - 1e-6)), n)
            np.maximum.at(peak, d, p)
            hot += np.bincount(d, p >= 0.5, n)
            for r, q in zip(rows[p >= 0.5], p[p >= 0.5], strict=True):
                at = int(offsets[doc[r]])
                spans[doc[r]].append({"from_byte": int(lo[r]) + a - at, "to_byte": int(hi[r]) + a - at, "marginal": float(q)})
        per = np.log1p(count)
        return np.column_stack([np.log1p(mass), peak, np.log1p(hot), np.log1p(1000 * mass / (count + 20)), np.log1p(mass) * per, per]), spans

    def score(self, column: pa.Array) -> tuple[np.ndarray, list[list[dict]]]:
        body, offsets = flat(column)
        n = len(offsets) - 1
        if self.constant is not None or not n:
            return np.full(n, self.constant or 0.0), [[] for _ in range(n)]
        x, spans = self.evidence(body, offsets)
        z = ((np.clip(x, self.low, self.high) - self.mean) / self.std) @ self.beta[:-1] + self.beta[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), spans


def learn(df: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_label: int = 800, max_bytes: int = 1 << 14, seed: int = 5) -> Model:
    got = sample_by_label(df, label_col, id_col, text_col, per_label, max_bytes, seed)
    rate = df.agg(F.avg(F.col(label_col).cast("double"))).first()[0]
    return Model(got["text"].to_pylist(), got["label"].to_pylist(), rate)


SPAN = T.ArrayType(T.StructType([T.StructField("from_byte", T.IntegerType()), T.StructField("to_byte", T.IntegerType()), T.StructField("marginal", T.DoubleType())]))


def tag(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score and spans (byte ranges of words with a marginal of one half or more, with it) of each document."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("spans", SPAN)])
    kind = pa.list_(pa.struct([("from_byte", pa.int32()), ("to_byte", pa.int32()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score, spans = shared.value.score(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array(spans, kind)], [id_col, "score", "spans"])
        give_back()

    return spread(df.select(id_col, text_col)).mapInArrow(run, schema)
