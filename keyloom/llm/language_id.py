"""Operator 6, language identification by hierarchical discrimination.

First the language family, then the language within the family: at both levels one-versus-one linear support vector
machines over hashed byte trigrams of the whole text (A-Z lower-cased, everything but letters and non-ASCII bytes read as
a space). A document's margin is the mean of its trigrams' weights, so a scoring pass reads every byte once and needs no
feature vectors. Confidence is the product, over both levels, of the winner's weakest pairwise probability.

Training uses a bounded sample: about `per_label` documents a language, none longer than `max_bytes`, drawn by a hash of
the id; all else covers every document.

Defined cases: null texts and texts without letters are `und` with score 0; rows with a null label are not learned from;
one learned language is always the answer; without any labelled row everything is `und`; long texts are read whole, in
pieces; repeated rows get equal answers; input columns other than id and text play no part.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.bytescan import flat, pieces, sample_by_label, span_sums
from keyloom.llm.common import give_back, reserve, ship, spread

#: The branch of each language code. Codes not listed are families of their own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "baltic": ["lt", "lv"],
    "uralic": ["et", "fi", "hu"],
    "indo-aryan": ["bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"],
    "turkic": ["az", "kk", "ky", "tr", "tt", "uz"],
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

BITS = 12
DIM = 1 << BITS
PIECE = 1 << 21

_letters = np.full(256, 32, np.uint8)
_letters[97:123] = np.arange(97, 123)
_letters[65:91] = np.arange(97, 123)
_letters[128:] = np.arange(128, 256)
_ascii_letter = (_letters != 32) & (np.arange(256) < 128)


def trigrams(body: np.ndarray) -> np.ndarray:
    """The hash, below DIM, of the trigram that begins at each byte but the last two."""
    x = _letters[body].astype(np.uint32)
    h = x[:-2] * np.uint32(2654435761)
    h += x[1:-1] * np.uint32(2246822519)
    h += x[2:] * np.uint32(3266489917)
    h ^= h >> np.uint32(15)
    h *= np.uint32(668265263)
    return (h >> np.uint32(32 - BITS)).astype(np.int32)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def features(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), DIM), np.float32)
    for i, t in enumerate(texts):
        body = np.frombuffer(t.encode(), np.uint8)
        if len(body) > 2:
            out[i] = np.bincount(trigrams(body), minlength=DIM) / (len(body) - 2)
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, rounds: int = 100, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine (squared hinge, accelerated gradient); y is 1 or -1, classes weigh the same."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    step = 1.0 / (2 * max(float(np.einsum("ij,ij->i", x, x).max()) + 1, 1e-6) + penalty)
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ vw + vb)) * weight * y
        nw, nb = vw + step * (2 * (x.T @ slack) - penalty * vw), vb + step * 2 * float(slack.sum())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / t2 * (nw - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = nw, nb, t2
    return w, b


class Model:
    """Pairwise machines among families and, for each family, among its languages."""

    def __init__(self, texts: list[str], labels: list[str]):
        self.languages = sorted(set(labels))
        family = {c: FAMILY_OF.get(c, c) for c in self.languages}
        self.families = sorted(set(family.values()))
        self.members = {f: [c for c in self.languages if family[c] == f] for f in self.families}
        self.pairs: list[tuple[str, str]] = [*combinations(self.families, 2)]
        for f in self.families:
            self.pairs += combinations(self.members[f], 2)
        x = features(texts)
        scale = 1 / (x.std(0) + 1e-5) if len(x) else np.ones(DIM, np.float32)
        norm = np.sqrt(((x * scale) ** 2).sum(1).mean()) if len(x) else 1.0
        scale = (scale / max(norm, 1e-9)).astype(np.float32)
        x *= scale
        lang, fam = np.array(labels), np.array([family[c] for c in labels])
        n = len(self.pairs)
        self.w, self.b = np.zeros((n, DIM), np.float32), np.zeros(n)
        for i, (p, q) in enumerate(self.pairs):
            of = fam if i < len(self.families) * (len(self.families) - 1) // 2 else lang
            rows = (of == p) | (of == q)
            w, self.b[i] = fit_svm(x[rows], np.where(of[rows] == p, 1, -1).astype(np.float32))
            self.w[i] = w * scale

    def margins(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, pairs)."""
        sums = np.zeros((len(offsets) - 1, len(self.pairs)))
        for doc, lo, hi in pieces(offsets, PIECE, overlap=2):
            a, z = int(lo[0]), int(hi[-1])
            grams = trigrams(body[a:z]) if z - a > 2 else np.zeros(0, np.int32)
            for j in range(len(self.pairs)):
                np.add.at(sums[:, j], doc, span_sums(self.w[j][grams], lo - a, np.maximum(hi - a - 2, lo - a)))
        return sums / np.maximum(np.diff(offsets) - 2, 1)[:, None] + self.b

    def choose(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        p = 1 / (1 + np.exp(-4 * np.clip(margins, -10, 10)))
        at = {pair: i for i, pair in enumerate(self.pairs)}

        def best(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """Index of the name that wins most pairs (then by the sum of its probabilities), and its weakest probability."""
            votes, total, weak = (np.zeros((len(p), len(names))) for _ in range(3))
            weak += 1
            for i, j in combinations(range(len(names)), 2):
                q = p[:, at[names[i], names[j]]]
                for k, r in ((i, q), (j, 1 - q)):
                    votes[:, k] += r > 0.5
                    total[:, k] += r
                    weak[:, k] = np.minimum(weak[:, k], r)
            won = np.argmax(votes + total / (len(names) + 1), 1)
            return won, weak[np.arange(len(p)), won]

        fam, sure = best(self.families)
        name = np.empty(len(p), object)
        for i, f in enumerate(self.families):
            rows = fam == i
            won, inner = best(self.members[f])
            name[rows] = np.array(self.members[f], object)[won[rows]]
            sure = np.where(rows, sure * inner, sure)
        return name.tolist(), sure

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        body, offsets = flat(column)
        n = len(offsets) - 1
        if not self.languages or not n:
            return ["und"] * n, np.zeros(n)
        names, sure = self.choose(self.margins(body, offsets))
        some = np.diff(offsets) > 0
        plain = np.zeros(n, bool)
        if some.any():
            plain[some] = np.logical_or.reduceat(_ascii_letter[body], offsets[:-1][some])
        for i in np.flatnonzero(~plain):
            # no ASCII letter: look for others
            if not has_letter(column[int(i)].as_py() or ""):
                names[i], sure[i] = "und", 0.0
        return names, sure


def learn(df: DataFrame, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_label: int = 400, max_bytes: int = 1 << 16, seed: int = 6) -> Model:
    got = sample_by_label(df, label_col, id_col, text_col, per_label, max_bytes, seed)
    return Model(got["text"].to_pylist(), got["label"].to_pylist())


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's columns plus lang_pred and score (input columns of these names come back with `_in`)."""
    df = reserve(df, ("lang_pred", "score"))
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.arrow_udf(kind)
    def answer(text: pa.Array) -> pa.Array:
        lang, sure = shared.value.predict(text)
        if text.nbytes > 1 << 20:
            give_back()
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(sure, pa.float64())], ["lang_pred", "score"])

    # only texts go to Python and only answers come back
    return spread(df).withColumn("__answer", answer(F.col(text_col).cast("string"))).select(*df.columns, "__answer.lang_pred", "__answer.score")
