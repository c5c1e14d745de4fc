"""Operators 2, 5 and 6: what they learn, edge cases, and that every byte counts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import bytescan, language_id, quality, toxicity
from tests.llm.helpers import documents, frame


def test_pieces_cover_long_texts_with_overlap():
    offsets = np.array([0, 0, 3, 25, 25, 30])
    got = [(d, a, b) for doc, lo, hi in bytescan.pieces(offsets, 10, overlap=2) for d, a, b in zip(doc, lo, hi)]
    assert got == [(0, 0, 0), (1, 0, 3), (2, 3, 13), (2, 11, 21), (2, 19, 25), (3, 25, 25), (4, 25, 30)]


def test_span_sums():
    v = np.arange(6, dtype=np.float32)
    assert bytescan.span_sums(v, np.array([0, 2, 2, 5]), np.array([2, 2, 5, 6])).tolist() == [1, 0, 9, 5]


def prose(r, alphabet, n):
    return " ".join("".join(r.choice(alphabet) for _ in range(r.randrange(2, 6))) for _ in range(n))


LANGS = {"en": ["th", "er", "ing", "on"], "de": ["sch", "ung", "ei", "ch"], "fr": ["eau", "é", "ou", "ai"], "es": ["ci", "ó", "ll", "do"]}


def test_language_id(spark):
    r = random.Random(1)
    rows = [(i, prose(r, LANGS[c], r.randrange(5, 60)), c, "s", 1) for i, c in enumerate(list(LANGS) * 40)]
    rows += [(900, None, "en", "s", 1), (901, "", "en", "s", 1), (902, "123 --- !!!", "fr", "s", 1), (903, "hello", None, "s", 1), (904, "日本語", "xx", "s", 1)]
    df = frame(spark, rows)
    model = language_id.learn(df.filter("doc_id % 3 != 1 and doc_id < 900"))
    out = {r.doc_id: r for r in language_id.identify(df.withColumn("score", F.lit("x")), model).collect()}
    held = [r for r in rows if r[0] % 3 == 1 and r[0] < 900]
    assert sum(out[i].lang_pred == c for i, _, c, *_ in held) >= 0.97 * len(held)
    assert [out[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and out[900].score == 0
    assert out[904].lang_pred in LANGS and all(0 <= r.score <= 1 for r in out.values())
    assert out[0].score_in == "x"
    nothing = language_id.learn(df.filter("false"))
    assert {r.lang_pred for r in language_id.identify(df, nothing).collect()} == {"und"}
    one = language_id.learn(df.filter("lang = 'de'"))
    assert {r.lang_pred for r in language_id.identify(df.filter("doc_id < 50"), one).collect()} == {"de"}
    assert language_id.identify(df.filter("false"), model).count() == 0


def test_language_margins_do_not_depend_on_pieces(monkeypatch):
    r = random.Random(2)
    texts = [prose(r, LANGS[c], 200) for c in LANGS for _ in range(3)] + ["", "ab"]
    model = language_id.Model(texts[:12], [c for c in LANGS for _ in range(3)])
    import pyarrow as pa

    whole = model.margins(*bytescan.flat(pa.array(texts)))
    monkeypatch.setattr(language_id, "PIECE", 50)
    assert np.allclose(whole, model.margins(*bytescan.flat(pa.array(texts))), atol=1e-6)


def toxic_rows(n=300):
    r = random.Random(3)
    rows = []
    for i in range(n):
        w = prose(r, ["ba", "ko", "re", "ti", "nu"], r.randrange(20, 120)).split(" ")
        bad = i % 4 == 0
        if bad:
            for _ in range(r.randrange(2, 6)):
                w.insert(r.randrange(len(w)), r.choice(["idiot", "IDIOTS!", "grumpfen", "grumpfisch"]))
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_toxicity(spark):
    rows = toxic_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(df.filter("doc_id % 5 != 0"))
    extra = spark.createDataFrame([(900, None, 0), (901, "", 0), (902, "clean " * 50_000 + "idiot idiot idiot", 1), (903, "123", 0)], df.schema)
    out = {r.doc_id: r for r in toxicity.tag(df.union(extra), model).collect()}
    held = [r for r in rows if r[0] % 5 == 0]
    assert sum((out[i].score >= 0.5) == bool(y) for i, _, y in held) >= 0.97 * len(held)
    for i, text, y in held:
        found = [text.encode()[s.from_byte : s.to_byte].decode().lower() for s in out[i].spans]
        if y:
            assert sum(w.startswith(("idiot", "grumpf")) for w in found) > 0.8 * len(found) > 0
    spans = out[902].spans
    assert ["clean " * 50_000 + "idiot idiot idiot"][0].encode()[spans[0].from_byte : spans[-1].to_byte] == b"idiot idiot idiot"
    assert out[900].score == out[901].score < 0.5 and not out[900].spans
    alone = toxicity.learn(df.filter("toxic = 1"))
    assert {r.score for r in toxicity.tag(df, alone).collect()} == {1.0}
    assert {r.score for r in toxicity.tag(df, toxicity.learn(df.filter("false"))).collect()} == {0.0}


def test_marginals_are_exact():
    """Windows around hits give what brute-force enumeration of the chain gives."""
    f = toxicity.Field(np.array([5, 9], np.uint64))
    f.w, f.bias, f.t = np.array([4.0, 2.5]), -3.0, np.array([[0.0, -1.0], [-0.5, 1.0]])
    n = 9
    rows, which = np.array([2, 3, 7]), np.array([0, 1, 1])
    at, p = f.marginals(np.zeros(n, np.int64), rows, which)
    assert at.tolist() == list(range(n))
    e = np.bincount(rows, f.w[which], n) + f.bias
    pad = 200  # neutral text around
    full = np.concatenate([np.full(pad, f.bias), e, np.full(pad, f.bias)])
    a = np.exp(f.t)
    alpha = np.zeros((len(full), 2))
    alpha[0] = [1, np.exp(full[0])]
    for i in range(1, len(full)):
        alpha[i] = (alpha[i - 1] @ a) * [1, np.exp(full[i])]
        alpha[i] /= alpha[i].sum()
    beta = np.ones((len(full), 2))
    for i in range(len(full) - 2, -1, -1):
        beta[i] = a @ (beta[i + 1] * [1, np.exp(full[i + 1])])
        beta[i] /= beta[i].sum()
    want = alpha * beta
    want = (want[:, 1] / want.sum(1))[pad : pad + n]
    assert np.allclose(p, want, atol=1e-7)


def test_words_do_not_depend_on_pieces(monkeypatch):
    import pyarrow as pa

    texts = ["idiot café", "", "clean words only here " * 40, "x" * 5, "ends idiot", "idiot"]

    def seen():
        return [(int(d), int(a) + lo) for doc, i, j, s, lo in toxicity.document_words(*bytescan.flat(pa.array(texts))) for d, a in zip(doc, i)]

    whole = seen()
    monkeypatch.setattr(toxicity, "PIECE", 100)
    monkeypatch.setattr(toxicity, "OVERLAP", 40)
    assert sorted(seen()) == sorted(whole)


def test_quality(spark):
    r = random.Random(4)
    rows = []
    for i in range(240):
        w = prose(r, ["ba", "ko", "re", "ti", "nu"], r.randrange(30, 200)).split(" ")
        kind = i % 4
        text = " ".join(w) if kind < 2 else " ".join(x + r.choice(["###", "&&&"]) for x in w) if kind == 2 else "!! ".join(w).upper()
        rows.append((i, text, int(kind < 2)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    net = quality.learn(df.filter("doc_id % 5 != 0"))
    extra = spark.createDataFrame([(900, None, 0), (901, "", 0), (902, rows[0][1] * 300 + rows[2][1] * 200, 0)], df.schema)
    out = {r.doc_id: r.score for r in quality.score(df.union(extra), net).collect()}
    held = [x for x in rows if x[0] % 5 == 0]
    assert sum((out[i] >= 0.3) == bool(y) for i, _, y in held) >= 0.95 * len(held)
    assert out[900] == out[901] and all(0 <= s <= 1 for s in out.values())
    assert quality.score(df.filter("false"), net).count() == 0
    assert {r.score for r in quality.score(df, quality.learn(df.filter("quality = 1"))).collect()} == {1.0}
    assert {r.score for r in quality.score(df, quality.learn(df.filter("false"))).collect()} == {0.5}


def test_quality_sees_the_end_of_a_long_document(monkeypatch):
    import pyarrow as pa

    net = quality.Network()
    texts = ["a" * 40_000, "a" * 39_990 + "#########!", "short", ""]
    score = net.score_texts(*bytescan.flat(pa.array(texts)))
    assert score[0] != pytest.approx(score[1], abs=1e-9)
    monkeypatch.setattr(quality, "BLOCKS_AT_ONCE", 3)
    assert np.allclose(score, net.score_texts(*bytescan.flat(pa.array(texts))), atol=1e-6)


def brute_quality(net, text):
    """One document by plain loops over places, chunks and units."""
    x = text.encode()
    blocks = max(-(-(len(x) + quality.WIDTH - 1) // quality.BLOCK), quality.PER_CHUNK)
    blocks += (blocks - quality.PER_CHUNK) % quality.STRIDE
    x = bytes(quality.WIDTH - 1) + x + bytes(blocks * quality.BLOCK - len(x))
    p = net.p
    near = [sum(p["filters"][k][x[i + k]].astype(float) for k in range(quality.WIDTH)) for i in range(blocks * quality.BLOCK)]
    best = None
    for first in range(0, blocks - quality.PER_CHUNK + 1, quality.STRIDE):
        pooled = np.maximum(np.max(near[first * quality.BLOCK : (first + quality.PER_CHUNK) * quality.BLOCK], 0), 0)
        chunk = np.tanh(pooled @ p["w1"] + p["b1"])
        best = chunk if best is None else np.maximum(best, chunk)
    return float(1 / (1 + np.exp(-(best @ p["w2"] + p["b2"][0]))))


def test_quality_equals_brute_force_whatever_the_neighbours():
    import pyarrow as pa

    r = random.Random(10)
    net = quality.Network(5)
    texts = ["", "a", "win $$$ now!!!", "é" * 40, "x" * 64, "y" * 59, "z" * 60, "$" * 256, *("".join(r.choice("ab $!é\n") for _ in range(r.randrange(700))) for _ in range(25))]
    texts += texts[:3]
    score = lambda ts: net.score_texts(*bytescan.flat(pa.array(ts, pa.string()))).tolist()
    got = score(texts)
    assert got == score(texts[::-1])[::-1] == [score([t])[0] for t in texts]
    assert got[:3] == got[-3:] and score([None]) == [got[0]]
    assert np.allclose(got, [brute_quality(net, t) for t in texts], atol=1e-5)


def test_quality_does_not_depend_on_partitions(spark):
    df = frame(spark, documents())
    net = quality.Network(6)
    scores = lambda d: sorted((str(r.doc_id), r.score) for r in quality.score(d.withColumn("Score", F.lit("x")), net).collect())
    assert scores(df.repartition(1)) == scores(df.repartition(7)) == scores(df.orderBy(F.desc("doc_id")))


def test_gradients():
    net = quality.Network(1)
    texts, y = [b"hello world " * 30, b"### !!! " * 20, b"x"], np.array([1, 0, 1], np.float32)

    def loss():
        import pyarrow as pa

        p = net.score_texts(*bytescan.flat(pa.array([t.decode() for t in texts])))
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    g = net._gradients(texts, y)
    for name, at in (("w2", (3,)), ("w1", (2, 5)), ("b1", (4,)), ("b2", (0,)), ("filters", (1, ord("o"), 2)), ("filters", (0, ord("#"), 7))):
        step = 1e-3
        net.p[name][at] += step
        up = loss()
        net.p[name][at] -= 2 * step
        down = loss()
        net.p[name][at] += step
        assert g[name][at] == pytest.approx((up - down) / (2 * step), abs=2e-3)


def test_models_on_awkward_documents(spark):
    df = frame(spark, documents())
    model = language_id.learn(df)
    assert language_id.identify(df, model).count() == len(documents())
    labelled = df.withColumn("quality", (F.col("doc_id") % 2).cast("int")).withColumn("toxic", F.col("quality"))
    assert quality.score(df, quality.learn(labelled)).count() == len(documents())
    assert toxicity.tag(df, toxicity.learn(labelled)).count() == len(documents())
