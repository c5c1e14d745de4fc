"""Operators 3, 7, 8, 9 and the pipeline."""

import hashlib
import random
import re
import struct
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece as spm
from pyspark.sql import functions as F

from keyloom.llm import html_extract, jaccard_join, queries, sentencepiece_codec, topk_search
from keyloom.llm.common import join_hot
from tests.llm.helpers import documents, frame
from tests.llm.test_native import FOLD, brute_hits, key_of

ODD = ["", " ", "  a  b ", "▁x ▁", "\n\n a\tb", "日本語 😀😀 x\x00", "ab" * 3000, "<s> </s> <0x41>", "é" * 5 + "▁▁ ", " ▁", "   x", "a" * 49, " nbsp　wide"]


@pytest.fixture(scope="module")
def library():
    return spm.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def expected(library, text):
    ids = library.encode(text, add_bos=True, add_eos=True)
    return ids, library.decode(ids)


def test_sentencepiece_equals_the_library(spark, library):
    rows = documents() + [(2000 + i, t, None, None, 0) for i, t in enumerate(ODD)]
    df = frame(spark, rows)
    got = {(r.doc_id): r for r in sentencepiece_codec.encode_digests(df, queries.piece_model()).collect()}
    tokens = {r.doc_id: r for r in sentencepiece_codec.encode_tokens(df, queries.piece_model()).collect()}
    for i, text, *_ in rows:
        ids, decoded = expected(library, text or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        t = tokens[i]
        assert t.ids == ids and t.decoded == decoded
        data = (text or "").encode()
        assert got[i].n_bytes_covered == len(data)
        # spans are in order, without gaps, and hold the bytes of their pieces
        assert t.from_byte[1:-1] == ([0] + t.to_byte[1:-2] if len(ids) > 2 else []) and (len(ids) == 2 or t.to_byte[-2] == len(data))
        for k in range(1, len(ids) - 1):
            if not library.is_byte(ids[k]):
                piece = library.id_to_piece(ids[k]).replace("▁", " ")
                span = data[t.from_byte[k] : t.to_byte[k]].decode().replace("▁", " ")
                assert span == (piece[1:] if k == 1 and piece.startswith(" ") else piece)
    assert sentencepiece_codec.encode_digests(frame(spark, []), queries.piece_model()).count() == 0


def test_cache_generations(library):
    c = sentencepiece_codec.Codec(queries.piece_model(), cache_size=3)
    for t in ["one two three four five six", "six five four three two one", "one one two"]:
        assert [c.bos, *c.encode(t)[0].tolist(), c.eos] == library.encode(t, add_bos=True, add_eos=True)


def double_array(rules):
    """A compiled character map of {source: target}, built naively: one free row of 256 units a node."""
    trie = {"next": {}, "leaf": None}
    strings, where = b"", {}
    for s, t in rules.items():
        where[s] = len(strings)
        strings += t.encode() + b"\0"
        node = trie
        for b in s.encode():
            node = node["next"].setdefault(b, {"next": {}, "leaf": None})
        node["leaf"] = where[s]
    units = [0] * 256
    place, queue = {id(trie): 0}, [trie]
    while queue:
        node = queue.pop(0)
        at = place[id(node)]
        base = len(units)
        units += [0] * 256
        offset = at ^ base
        units[at] = units[at] & 0x800000FF | (offset << 10 if offset < 1 << 21 else 0) | (1 << 8 if node["leaf"] is not None else 0)
        if node["leaf"] is not None:
            units[base] = 1 << 31 | node["leaf"]
        for b, child in node["next"].items():
            units[base ^ b] = b
            place[id(child)] = base ^ b
            queue.append(child)
    trie_bytes = struct.pack(f"<{len(units)}I", *units)
    return struct.pack("<I", len(trie_bytes)) + trie_bytes + strings


def test_longest_prefix_normalisation_and_alignment():
    from sentencepiece import sentencepiece_model_pb2 as pb

    rules = {"ﬁ": "fi", "A": "a", "AB": "x", "①": "1", "é": "é", "\t": " "}
    m = pb.ModelProto()
    m.ParseFromString(queries.piece_model())
    m.normalizer_spec.precompiled_charsmap = double_array(rules)
    lib = spm.SentencePieceProcessor(model_proto=m.SerializeToString())
    c = sentencepiece_codec.Codec(m.SerializeToString())
    assert not c.identity
    for text in ["ABA", "ﬁne A①", "café\tAB", "x", "", "A" * 100, "日本 ﬁ"]:
        ids, lo, hi = c.encode(text)
        assert ids.tolist() == lib.encode(text), text
        data = text.encode()
        assert (lo[1:] >= lo[:-1]).all() and (not len(hi) or hi[-1] == len(data))
    normal, starts = c.normalize("ABAﬁ")
    assert normal == "▁xafi" and starts == [0, 0, 2, 3, 3, 6]


def test_main_path_normalises_each_distinct_cut(library):
    c = sentencepiece_codec.Codec(queries.piece_model())
    walked, whole = [], c.normalize
    c.normalize = lambda text, *more, **how: walked.append(text) or whole(text, *more, **how)
    text = "the cat, the  café the cat 日本"
    assert c.identity
    first, again = c.digest(text), c.digest(text)
    assert first == again and len(walked) == len(set(walked)) and set(c.source_cut.findall(" " + text)) == set(walked)
    ids, lo, hi = c.encode(text)
    assert [c.bos, *ids.tolist(), c.eos] == library.encode(text, add_bos=True, add_eos=True)
    # spans are those of the whole text's walk
    c.identity = False
    assert [x.tolist() for x in c.encode(text)] == [ids.tolist(), lo.tolist(), hi.tolist()]


def test_new_words_are_merged_together(library):
    rng = random.Random(3)
    parts = ["on", "er", "th", "ción", "schü", "ß", "a", "aa", "é", "日", "😀", "x\0", "&&&", ".\n", "9", "Qu", "e" * 49, "  "]
    texts = [" ".join("".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(200)) for _ in range(20)] + ODD
    for cache_size in (150_000, 50):  # the second is full again and again amid a text
        c = sentencepiece_codec.Codec(queries.piece_model(), cache_size=cache_size)
        alone, merge = [], c.merge
        c.merge = lambda text, alone=alone, merge=merge: alone.append(text) or merge(text)
        for t, (n, ids_sha256, decoded_sha256, covered) in zip(texts, c.digests(texts), strict=True):
            ids, decoded = expected(library, t)
            assert (n, ids_sha256, covered) == (len(ids), hashlib.sha256(struct.pack(f"<{n}I", *ids)).hexdigest(), len(t.encode()))
            assert decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
        if cache_size > 50:  # one at a time: only words with unknown characters, long ones, and the few of texts with U+2581
            assert not [w for w in alone if len(w) <= 48 and all(x in c.ids for x in w) and "▁" not in w[1:] and w not in " ".join(ODD).replace(" ", "▁")]
            assert all(kept[2] is raw for raw, kept in c.words.items() if kept[2] == raw)
    # ties: the leftmost of equal pairs first, as alone
    m = sentencepiece_codec.Merges({"ab": 1.0, "bc": 1.0, "cd": 1.0, "abab": 0.5}, {s: i for i, s in enumerate(["ab", "bc", "cd", "abab", "a", "b", "c", "d"])})
    ids, widths, counts = m.split(["abcd", "bcd", "ababab", "z"], np.array([*range(5), *range(4), *range(7), 0, 2]))
    assert ids.tolist() == [0, 2, 1, 7, 3, 0, -1] and widths.tolist() == [2, 2, 2, 1, 4, 2, 2] and counts.tolist() == [2, 2, 2, 1]


# 7 -----------------------------------------------------------------------------------------------------------------------


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(FOLD))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 5, 0) + 1)} if w else set()


def brute_components(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            named = rows[i][0] is not None and rows[j][0] is not None
            if both and 100 * both >= 80 * len(sets[i] | sets[j]) and (named or sets[i] == sets[j]):
                parent[root(i)] = root(j)
    low = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[root(i)].append(r[0])
    return sorted(repr((r[0], len(sets[i]), min(low[root(i)], default=None))) for i, r in enumerate(rows))


def got_components(df, **how):
    return sorted(repr(tuple(r)) for r in jaccard_join.link_components(df, **how).select("doc_id", "n_shingles", "component_id").collect())


def test_jaccard_components(spark):
    rows = documents(90)
    r = random.Random(8)
    base = [f"w{r.randrange(400)}" for _ in range(120)]
    for i in range(40):  # chains of near copies around the threshold, beyond the small-bucket size
        base = list(base)
        base[r.randrange(len(base))] = f"n{i}"
        rows.append((2000 + i, " ".join(base), "en", "s", 1))
    for i in range(60):  # small sets
        rows.append((3000 + i, " ".join(r.choice(["a", "b"]) for _ in range(r.randrange(1, 14))), "en", "s", 1))
    assert got_components(frame(spark, rows).withColumn("node", F.lit(1)).withColumn("n_shingles", F.lit(1))) == brute_components(rows)
    assert got_components(frame(spark, [])) == []
    assert got_components(frame(spark, [(5, None, "", "", 0), (4, "", "", "", 0)])) == ["(4, 0, 4)", "(5, 0, 5)"]


@pytest.mark.parametrize("how", [{}, {"family_rows": 1}, {"family_rows": 1, "group_rows": 3}])
def test_copies_around_the_threshold(spark, how):
    """A large group of copies with many edits, few of which link to each other, with and without room for a family, or a group, in one task."""
    r = random.Random(12)
    base = [f"w{r.randrange(4000)}" for _ in range(150)]
    rows = []
    for i in range(70):
        words = list(base)
        for _ in range(r.choice([1, 3, 4, 5, 6])):
            words[r.randrange(150)] = f"e{r.randrange(30)}"
        if i % 9 == 0:
            words = words[: 150 - r.randrange(30)]
        rows.append((i, " ".join(words), "en", "s", 1))
    want = brute_components(rows)
    assert 2 < len({eval(x)[2] for x in want}) < 60
    assert got_components(frame(spark, rows), **how) == want


def test_hot_keys_of_a_join_stay_where_they_are(spark):
    left = spark.createDataFrame([(i, None if i % 10 == 0 else "hot" if i % 3 else f"k{i % 7}") for i in range(400)], "i long, k string")
    right = spark.createDataFrame([("hot", 1, None), ("k1", 2, "x"), ("k2", None, "y"), ("alone", 3, "z")], "k string, n int, s string")
    want = {r.i: (r.k, r.n, r.s) for r in left.join(right, "k", "left").collect()}
    for how in ({"least": 100, "share": 50}, {}, {"least": 10, "share": 50}):
        out = join_hot(left, right, "k", "t", **how)
        assert set(out.columns) == {"i", "k", "n", "s"} and {r.i: (r.k, r.n, r.s) for r in out.collect()} == want and out.count() == 400
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = join_hot(left, right, "k", "t", least=100, share=50)._jdf.queryExecution().executedPlan().toString()
        # settled rows are dealt out by their spreading number
        assert re.search(r"hashpartitioning\([^\n]*__ts", plan) and "BroadcastHashJoin" in plan, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sets_without_a_guarantee_meet_by_their_first_elements():
    """Pairs of sets whose elements all fall into one segment share an entry."""
    r = np.random.default_rng(3)
    for size in (5, 9, 13):
        m = jaccard_join.band(jaccard_join.bands_of(size)[0])[2]
        one = r.integers(0, (1 << 64) // m - 1, size + 1, dtype=np.uint64)  # the first segment of all bands
        a, b = np.unique(one[:size]), np.unique(one[1:] if size < 9 else np.append(one[1:size], one[size]))
        if 100 * len(np.intersect1d(a, b)) < 80 * len(np.union1d(a, b)):
            continue
        keys, member, owner, slack = jaccard_join.index_entries([a, b])
        assert set(keys[owner[member] == 0].tolist()) & set(keys[owner[member] == 1].tolist())
        assert ((slack & 0xFFFF) == 0).any()


def test_scratch_tables_go(spark):
    from keyloom.llm.common import scratch, stored, tables

    folder = scratch(spark)
    stored(spark.range(3), folder, "a")
    assert tables(spark, folder) == ["a"]
    before = spark.conf.get("spark.checkpoint.dir", None)
    jaccard_join.link_components(frame(spark, documents(20))).count()
    assert spark.conf.get("spark.checkpoint.dir", None) == before


def test_shared_passage_does_not_link(spark):
    r = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([f"w{r.randrange(10**6)}" for _ in range(90)] + passage), "en", "s", 1) for i in range(80)]
    rows += [(100 + i, rows[i][1] + " tail", "en", "s", 1) for i in range(20)]
    assert got_components(frame(spark, rows)) == brute_components(rows)


@pytest.mark.parametrize("size", [2, 3, 4, 5, 9, 17, 33, 70, 200])
def test_every_linked_pair_shares_an_entry(size):
    """The pigeonhole guarantee, at the largest difference that still links."""
    r = np.random.default_rng(size)
    for _ in range(40):
        x = r.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2)
        drop = int(r.integers(0, size // 5 + 1))
        y = x[drop:]
        add = 0
        while 100 * len(y) >= 80 * (size + add + 1):
            add += 1
        y = np.concatenate([y, r.integers(0, 1 << 63, add, dtype=np.uint64)])
        a, b = np.unique(x), np.unique(y)
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * (len(a) + len(b) - both):
            continue
        assert 9 * jaccard_join.sketch_distance(jaccard_join.odd_sketch(a), jaccard_join.odd_sketch(b)) <= len(a) + len(b)
        if len(a) == len(b) and (a == b).all():
            continue
        keys, member, owner, slack = jaccard_join.index_entries([a, b])
        of = owner[member]
        assert set(keys[of == 0].tolist()) & set(keys[of == 1].tolist())


def test_words_of_texts_do_not_touch(monkeypatch):
    import pyarrow as pa

    from keyloom.llm.bytescan import flat

    texts = ["One two", "two", "", " x ", "one two", "w" * 300 + " y", "ONE TWO"]
    whole = [s.tolist() for s in jaccard_join.shingle_sets(*flat(pa.array(texts)))]
    assert whole[0] == whole[4] == whole[6] != whole[1]
    monkeypatch.setattr(jaccard_join, "PIECE", 64)
    assert [s.tolist() for s in jaccard_join.shingle_sets(*flat(pa.array(texts)))] == whole


def test_contraction_of_a_path(spark, tmp_path):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (150, 200)], "a long, b long")
    got = {r.node: r.comp for r in jaccard_join.components(edges, f"file://{tmp_path}", "t").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 200: 100}


# 8 -----------------------------------------------------------------------------------------------------------------------


def brute_top(rows, is_query, k=10):
    """{(query id, query, rank): (id, exact score)} with whole numbers of any size."""
    ints = [(i, tuple(int(np.floor(1024 * float(np.float32(x)))) if abs(x) < 1e9 else int(1024 * x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for i, v in set(ints):
        if is_query(i):
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ints if j != i and len(w) == len(v))[:k]
            want += [(i, n + 1, j, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for n, (s, j) in enumerate(scores)]
    return sorted(want)


def got_top(q, is_query, **how):
    return sorted(tuple(x) for x in topk_search.top_k(q.filter(is_query), q, 10, **how).collect())


@pytest.mark.parametrize("how", [{}, {"pilots": 20}, {"broadcast_bytes": 0, "group_bytes": 3000, "pilots": 30}, {"broadcast_bytes": 0, "pilots": 1}])
def test_top_k(spark, how):
    r = random.Random(6)
    rows = [(i, [r.choice([-0.5, 0.25, r.random()]) for _ in range(16)]) for i in range(150)]
    rows += [(150, None), (151, []), (152, [float("nan")] * 16), (153, [None] + [0.1] * 15), (154, [float("inf")] * 16), (155, [0.5] * 4), (156, [0.25] * 4), (None, [0.9] * 16), (7, [1.0] * 16), (157, rows[0][1])]
    rows += [rows[10], rows[10], (20, [0.125] * 16), rows[33]]  # repeated queries, a query id with two vectors, a repeated candidate
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("rank", F.lit(1)).withColumn("id", F.lit(2))
    q = topk_search.quantize(df, "vec_id", "embedding")
    assert got_top(q, "id % 5 = 0", **how) == brute_top(rows, lambda i: i % 5 == 0)
    none = topk_search.quantize(df.filter("false"), "vec_id", "embedding")
    assert topk_search.top_k(none, none, **how).count() == 0 and topk_search.top_k(q.filter("id = 5"), none, **how).count() == 0


@pytest.mark.parametrize("how", [{}, {"broadcast_bytes": 0, "group_bytes": 4000}])
def test_top_k_of_large_components_is_exact(spark, how):
    r = random.Random(7)
    rows = [(0, [3e6, 3e6 + 1, 3e6 + 3]), (1, [3e6, 3e6 + 1, 3e6 + 2]), (2, [1.0, 2.0, 3.0]), (3, [-3e6, -3e6, 1.0]), (100, [1e200, -1e200, 1e3]), (101, [1e200, -1e200, -1e3]), (102, [-1e250, 0.0, 0.0])]
    rows += [(200 + i, [1e5 + r.random() for _ in range(64)]) for i in range(40)] + [(300 + i, [1e6 * r.random() for _ in range(64)]) for i in range(40)] + [(400 + i, [r.random() for _ in range(64)]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = topk_search.quantize(df, "vec_id", "embedding")
    scaled = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows}
    want = []
    for i, v in scaled.items():
        if i % 10 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in scaled.items() if j != i and len(w) == len(v))[:10]
            want += [(i, n + 1, j, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for n, (s, j) in enumerate(scores)]
    assert got_top(q, "id % 10 = 0", **how) == sorted(want)


def test_bounds_hold_and_prune():
    r = np.random.default_rng(1)
    x, y = r.normal(size=(50, 33)), r.normal(size=(40, 33))
    for s in topk_search.resolutions(33):
        assert (topk_search.statistics(x, s) @ topk_search.statistics(y, s).T >= x @ y.T - 1e-9).all()
    share = {}
    flat = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    loose = flat(r.normal(size=(20_000, 64)))
    steps = flat(np.repeat(r.normal(size=(20_000, 4)), 16, 1) + 0.05 * r.normal(size=(20_000, 64)))
    for name, v in (("unstructured", loose), ("smooth", steps)):
        v = np.floor(1024 * v)
        block = topk_search.Block(np.arange(20), v[:20], 10)
        for at in range(0, len(v), 2048):
            block.add(topk_search.Rows(np.arange(at, min(at + 2048, len(v))), v[at : at + 2048]))
        for i in range(20):
            score = v @ v[i]
            score[i] = -np.inf
            assert block.best[i] == sorted((-int(s), int(j)) for j, s in enumerate(score) if j != i)[:10]
        share[name] = block.scored / block.pairs
    assert share["smooth"] < 0.15 and share["unstructured"] < 0.6, share


# 9 -----------------------------------------------------------------------------------------------------------------------

CLASSIFIER = html_extract.train(["<nav><a href=x>Home</a></nav><article><p>Some words here, and more. Quite long text that goes on, with commas.</p></article><footer>© x</footer>"] * 3)

PAGES = {
    "": "",
    "plain text": "plain text",
    "<body><header><a href=/>Site</a></header><article><header><h1>T</h1></header><p>A&nbsp;b &lt;x&gt; &am</p><div class='ad'>buy</div><p>C</p><section id=comments><p>first comment here.</p></section></article><aside><p>side</p></aside></body>": "T\nA b <x> &am\nC",
    "<article><p>a <b>b</b>c<br>d\n e<br><br>f<p>g<script>var t='</p>';</script><style>p{}</style><!-- x --></article>": "a bc d e\nf\ng",
    "<main><p>x<form><p>name</p></form><div class='cookie-notice'>We use</div></main><article class=comment>no</article>": "x",
    "<article><ul><li>one<li>two</ul><table><tr><td>1<td>2</table></article>": "one\ntwo\n1\n2",
    "<article><p>a < b & c</p><p hidden>no</p><p style='display: none'>no</p></article><p": "a < b & c",
    "<article><p>Sh is.</p><p>" + "long " * 30_000 + "</p></article>": "Sh is.\n" + ("long " * 30_000).strip(),
}


def test_extraction():
    for page, want in PAGES.items():
        assert html_extract.extract(page, CLASSIFIER) == want


def test_extraction_query_shape(spark):
    rows = [(i, "u", p) for i, p in enumerate(PAGES)] + [(100, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    out = html_extract.extract_texts(df, html_extract.learn(df)).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) and r.text_in == 1 for r in out)
    assert html_extract.extract_texts(df.filter("false"), CLASSIFIER).count() == 0


def made_page(r, kind):
    """(page, its article's blocks), with roles by element, by class, or none at all."""
    word = lambda: "".join(r.choice("abdeinorstu") for _ in range(r.randrange(2, 8)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + r.choice([".", ".", "!", "?"])
    para = lambda: " ".join(sentence(r.randrange(4, 14)) if r.random() < 0.7 else sentence(5)[:-1] + ", " + sentence(6) for _ in range(r.randrange(1, 6)))
    links = lambda n: "<ul>" + "".join(f"<li><a href=/{word()}>{word()}</a></li>" for _ in range(n)) + "</ul>"
    body = [sentence(6)[:-1], *(sentence(r.randrange(1, 4)) if r.random() < 0.25 else para() for _ in range(r.randrange(4, 10)))]
    inner = [f"<h1>{body[0]}</h1>", *(f"<p>{x}</p>" for x in body[1:])]
    if kind == "tags":
        inner.insert(r.randrange(1, len(inner)), f"<aside><p>{para()}</p></aside>")
        inner.insert(r.randrange(1, len(inner)), f"<div class='advert'>{para()}</div>")
        inner.append(f"<section class='user-comments'><p>{para()}</p><p>{para()}</p></section>")
        return f"<body><header><a href=/>{word()}</a></header><nav>{links(5)}</nav><article>{''.join(inner)}</article><form><p>{sentence(8)}</p></form><footer>&copy; {sentence(4)}</footer></body>", body
    if kind == "classes":
        return f"<body><div id=masthead>{word()}</div><div class=nav-bar>{links(6)}</div><div class=cookie-notice><p>{para()}</p></div><div class=post-body><div>{''.join(inner)}</div></div><div class=comments><p>{para()}</p></div><div class=sidebar>{links(4)}<p>{para()}</p></div></body>", body
    # paragraphs that are links, and links with a few words of text between
    at = r.randrange(2, len(inner))
    body[at] = sentence(4)
    inner[at] = f"<p><a href=/{word()}>{body[at][:-1]}</a>{body[at][-1]}</p>"
    teasers = "".join(f"<div><a href=/{word()}>{sentence(4)}</a></div><div>{sentence(3)}</div>" for _ in range(4))
    return f"<body><div>{links(7)}</div><div><div>{''.join(inner)}</div></div><div>{teasers}</div><div>&copy; {word()} | {word()} | {word()}</div></body>", body


def test_extraction_of_made_pages():
    r = random.Random(14)
    model = html_extract.train([made_page(r, "tags")[0] for _ in range(90)])
    for kind in ("tags", "classes", "bare"):
        whole = right = right_alone = blocks = changed = 0
        for _ in range(60):
            page, want = made_page(r, kind)
            whole += html_extract.extract(page, model) == "\n".join(want)
            held = html_extract.blocks_of(page)
            odds = model.odds(html_extract.shallow(held)).tolist()
            keep = html_extract.Graph(held).labels(odds, model.weights)
            truth = [b.text in want for b in held]
            blocks += len(held)
            right += sum(k == t for k, t in zip(keep, truth))
            right_alone += sum((o > 0) == t for o, t in zip(odds, truth))
            changed += sum((o > 0) != k for o, k in zip(odds, keep))
        assert changed and right > right_alone, (kind, right, right_alone)
        assert whole == 60 or kind == "bare"


def test_labels_are_a_least_cost_cut():
    """Against all labellings of the blocks and elements of small pages."""
    from itertools import product

    r = random.Random(15)
    for n in range(12):
        tag = r.choice(["article", "div", "nav"])
        page = f"<{tag}><p>{'One two, three. ' * r.randrange(1, 9)}</p><p>x</p></{tag}><div class={r.choice(['ad', 'x', 'content'])}>Some words here.</div>"
        graph = html_extract.Graph(html_extract.blocks_of(page))
        odds = CLASSIFIER.odds(html_extract.shallow(graph.blocks)).tolist()
        size = len(graph.blocks) + len(graph.elements)
        cost = [*odds, *([0.0] * len(graph.elements))]
        for at, (own, spoken) in graph.speaks.items():
            cost[at] = own * len(spoken)
        edges = [*graph.above, *((i, j, 0.5 * nxt + 0.3 * share) for i, j, nxt, share in graph.near)]
        total = lambda k: sum(abs(c) for c, x in zip(cost, k) if (c > 0) != x) + sum(w for i, j, w in edges if k[i] != k[j])
        best = min(product([False, True], repeat=size), key=total)
        got = graph.labels(odds, (0.5, 0.3))
        fixed = min((total(got + list(rest)) for rest in product([False, True], repeat=len(graph.elements))))
        assert fixed == pytest.approx(total(best), abs=0.02)


def test_min_cut_is_minimal():
    from itertools import product

    r = random.Random(5)
    for _ in range(60):
        n = r.randrange(1, 8)
        score = [r.randrange(-9, 10) for _ in range(n)]
        edges = [(a, b, r.randrange(1, 6)) for a in range(n) for b in range(a) if r.random() < 0.5]
        cost = lambda k: sum(s for s, x in zip(score, k) if s > 0 and not x) - sum(s for s, x in zip(score, k) if s < 0 and x) + sum(c for a, b, c in edges if k[a] != k[b])
        assert cost(html_extract.min_cut(score, edges)) == min(cost(k) for k in product([False, True], repeat=n))


# pipeline ----------------------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path, library):
    import corpus_pipeline as pipeline

    rows = [r for r in documents(80) if r[0] is not None][:-1]
    items = [(1, " ".join(rows[10][1].split()[:14])), (2, "nothing like it anywhere in these texts at all, none")]
    frame(spark, rows).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in pipeline.run(spark, str(tmp_path)).collect()}

    docs = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    holders = defaultdict(set)
    for i, text, *_ in docs:
        for line in text.split("\n"):
            holders[key_of(line)].add(i)
    cut = []
    for i, text, *rest in docs:
        kept = [x for x in text.split("\n") if not (len(key_of(x)) >= 10 and len(holders[key_of(x)]) >= 2 and min(holders[key_of(x)]) != i)]
        cut.append((i, "\n".join(kept), *rest))
    comp = {eval(c)[0]: eval(c)[2] for c in brute_components(cut)}
    cut = [r for r in cut if comp[r[0]] == r[0]]
    hits = brute_hits(cut, items)
    left = [r for r in cut if not hits[r[0], r[1]][1]]
    assert len(left) < len(cut) < len(docs) < len(rows)
    want = {}
    for i, text, *_ in left:
        ids, decoded = expected(library, text)
        want[i] = (len(ids), hashlib.sha256(decoded.encode()).hexdigest())
    assert got == want
    docs_df = frame(spark, rows)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs_df.limit(20), str(tmp_path))
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name


