"""The opN_ queries themselves, on small tables: their columns, digests and defined cases, against plain Python."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyloom.llm import bytescan, html_extract, language_id, quality, queries, sharding, toxicity
from tests.llm.helpers import check_path, crc, documents, frame
from tests.llm.test_models import LANGS, prose, toxic_rows


def test_op1(spark, tmp_path):
    rows = documents(70)
    out = queries.op1_sharding(spark, check_path(spark, tmp_path, "documents", frame(spark, rows)))
    assert dict(out.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    got = out.collect()
    size = lambda t: len((t or "").encode()) + 16
    assert sorted(repr((r.doc_id, r.size, r.text_crc32)) for r in got) == sorted(repr((i, size(t), zlib.crc32((t or "").encode()))) for i, t, *_ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    counts = [len(slots[k]) for k in range(40)]
    assert set(slots) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(counts) - min(counts) <= 1
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}


def test_one_row_repeated_often_is_spread(spark):
    df = spark.range(6000).select(F.when(F.col("id") < 4000, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 4000, F.lit("same")).otherwise(F.lit("x")).alias("text"))
    out = sharding.shuffle_into_shards(df, 8, min_buckets=16, hot_rows=500)
    got = out.collect()
    places = sorted((r.shard, r.slot) for r in got)
    assert places == [(s, k) for s in range(8) for k in range(750)]
    same = defaultdict(int)
    for r in got:
        same[r.shard] += r.doc_id == 7
    assert all(350 < n < 650 for n in same.values()), same


@pytest.fixture(scope="module")
def labelled():
    """Documents and labels for both classifiers."""
    r = random.Random(21)
    docs, labels = [], []
    for i, text, bad in toxic_rows(260):
        poor = i % 3 == 0
        text = " ".join(w + "###" for w in text.split(" ")) if poor else text
        docs.append((i, text, r.choice(["en", None]), r.choice(["a", "b"]), len(text)))
        labels.append((i, int(not poor), bad))
    docs += [(1000, None, "en", "a", None), (1001, "", "en", "a", 0), (1002, docs[0][1], None, None, 1), docs[1], (1003, docs[0][1] * 200, "en", "a", 1)]
    labels += [(2000, 1, 0), (1001, None, None)]
    return docs, labels


@pytest.mark.parametrize("query, label, least", [(queries.op2_quality_classifier, 1, 0.3), (queries.op5_toxicity, 2, 0.5)])
def test_op2_and_op5(spark, tmp_path, labelled, query, label, least):
    docs, labels = labelled
    path = check_path(spark, tmp_path, "documents", frame(spark, docs))
    check_path(spark, tmp_path, "labels", spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = query(spark, path)
    assert dict(out.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    got = out.collect()
    assert sorted(r.doc_id for r in got) == sorted(d[0] for d in docs)
    for r in got:
        assert r.held_out == (crc(r.doc_id) % 5 == 0) and r.predicted == int(r.score >= least) and 0 <= r.score <= 1
    by = {r.doc_id: r.score for r in got}
    assert by[1000] == by[1001] and by[1002] == by[0] and len({r.score for r in got if r.doc_id == docs[1][0]}) == 1
    truth = {x[0]: x[label] for x in labels if x[label] is not None}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 30 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    # labels of held-out rows, and all that is not text, play no part
    changed = [(i, q if crc(i) % 5 else 1 - (q or 0), t if crc(i) % 5 else 1 - (t or 0)) for i, q, t in labels]
    check_path(spark, tmp_path, "labels", spark.createDataFrame(changed, "doc_id long, quality int, toxic int"))
    check_path(spark, tmp_path, "documents", frame(spark, [(i, t, "zz", "q", 0) for i, t, *_ in docs]))
    assert {(r.doc_id, r.score) for r in query(spark, path).collect()} == {(r.doc_id, r.score) for r in got}


def test_op6(spark, tmp_path):
    r = random.Random(31)
    docs = [(i, prose(r, LANGS[c], r.randrange(5, 50)), c, "s", 1) for i, c in enumerate(list(LANGS) * 45)]
    docs += [(900, None, "en", "s", 1), (901, "", "en", "s", 1), (902, "12 -- !", "fr", "s", 1), (903, docs[0][1], None, "s", 1), docs[5]]
    path = check_path(spark, tmp_path, "documents", frame(spark, docs))
    out = queries.op6_language_id(spark, path)
    assert dict(out.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}
    got = out.collect()
    assert sorted(x.doc_id for x in got) == sorted(d[0] for d in docs)
    assert all(x.held_out == (crc(x.doc_id) % 3 == 1) and 0 <= x.score <= 1 and x.lang_pred in {*LANGS, "und"} for x in got)
    by = {x.doc_id: x for x in got}
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and by[903].lang_pred == by[0].lang_pred
    truth = {d[0]: d[2] for d in docs[:180]}
    held = [x for x in got if x.held_out and x.doc_id in truth]
    assert len(held) > 30 and sum(x.lang_pred == truth[x.doc_id] for x in held) >= 0.97 * len(held)
    # labels of held-out rows are not learned from
    check_path(spark, tmp_path, "documents", frame(spark, [(i, t, c if crc(i) % 3 != 1 else "zz", "q", 0) for i, t, c, *_ in docs]))
    assert {tuple(x) for x in queries.op6_language_id(spark, path).collect()} == {tuple(x) for x in got}


def brute_language(model, text):
    """Family first, then language, by sums over every trigram of one text."""
    if not any(c.isalpha() for c in text):
        return "und", 0.0
    body = np.frombuffer(text.encode(), np.uint8)
    margin = {}
    for n, pair in enumerate(model.pairs):
        total = sum(float(model.w[n][language_id.trigrams(body[i : i + 3])[0]]) for i in range(len(body) - 2))
        margin[pair] = total / max(len(body) - 2, 1) + model.b[n]
    sure = 1.0

    def best(names):
        nonlocal sure
        p = {}
        for (a, b), m in margin.items():
            if a in names and b in names:
                p[a, b] = 1 / (1 + np.exp(-4 * np.clip(m, -10, 10)))
                p[b, a] = 1 - p[a, b]
        key = lambda a: (sum(p[a, b] > 0.5 for b in names if b != a), sum(p[a, b] for b in names if b != a))
        won = max(names, key=key)
        sure *= min([p[won, b] for b in names if b != won], default=1.0)
        return won

    return best(model.members[best(model.families)]), sure


def test_language_scores_equal_brute_force():
    r = random.Random(32)
    texts = [prose(r, LANGS[c], 30) for c in LANGS for _ in range(6)]
    model = language_id.Model(texts, [c for c in LANGS for _ in range(6)])
    asked = [prose(r, LANGS[c], k) for c in LANGS for k in (1, 4, 40)] + ["", "1 2", "é", "日本", "AB", "Don't"]
    names, sure = model.predict(pa.array(asked))
    for t, name, s in zip(asked, names, sure):
        want, score = brute_language(model, t)
        assert name == want and s == pytest.approx(score, abs=1e-4)


def test_op9(spark, tmp_path):
    r = random.Random(41)
    from tests.llm.test_search_and_text import made_page

    made = [made_page(r, "tags") for _ in range(60)]
    rows = [(i, f"u{i}", p) for i, (p, _) in enumerate(made)] + [(900, "u", None), (901, None, ""), (902, "u", "<nav>x</nav>"), (0, "again", made[0][0])]
    path = check_path(spark, tmp_path, "pages", spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")))
    out = queries.op9_html_extraction(spark, path)
    assert dict(out.dtypes) == {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}
    got = out.collect()
    assert sorted((x.page_id, str(x.url)) for x in got) == sorted((i, str(u)) for i, u, _ in rows)
    for x in got:
        want = "\n".join(made[x.page_id][1]) if x.page_id < 900 else ""
        assert x.text == want and x.n_chars == len(want)


def test_scores_do_not_depend_on_the_batch():
    """Operators 5, 6 and 9 as operator 2: alone and among others."""
    rows = toxic_rows(120)
    model = toxicity.Model([t for _, t, _ in rows], [y for *_, y in rows])
    texts = [t for _, t, _ in rows[:40]] + ["", "idiot"]
    whole = model.score(pa.array(texts))[0]
    assert np.allclose(whole, [model.score(pa.array([t]))[0][0] for t in texts], atol=1e-9)
    lang = language_id.Model(texts[:40], ["en" if i % 2 else "de" for i in range(40)])
    assert np.allclose(lang.predict(pa.array(texts))[1], [lang.predict(pa.array([t]))[1][0] for t in texts], atol=1e-6)
    assert html_extract.train([]).weights in ((0.5, 0.3), *html_extract.GRID)
    assert quality.Network().score_texts(*bytescan.flat(pa.array(texts))).shape == (42,)


def test_few_files_are_dealt_over_the_cores(spark, tmp_path):
    from keyloom.llm.common import spread

    for files, parts in ((1, 4), (6, None)):
        path = f"file://{tmp_path}/f{files}"
        spark.range(1000).repartition(files).write.parquet(path)
        df = spark.read.parquet(path)
        out = spread(df)
        assert out.rdd.getNumPartitions() == (parts or df.rdd.getNumPartitions()) and sorted(r.id for r in out.collect()) == list(range(1000))
    made = spark.range(5)
    assert spread(made) is made
