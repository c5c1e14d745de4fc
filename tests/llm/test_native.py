"""Operators 1, 4 and 10 against brute force."""

import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from keyloom.llm import decontaminate, line_dedup, sharding
from tests.llm.helpers import SCHEMA, documents, frame

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\f\r"


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan), plan


def test_sharding(spark):
    rows = documents()
    df = frame(spark, rows).withColumn("shard", F.lit("mine"))
    out = sharding.shuffle_into_shards(df, 7, seed=1)
    no_python(out)
    got = out.collect()
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard_in", "shard", "slot"]
    assert sorted(map(repr, [tuple(r)[:5] for r in got])) == sorted(map(repr, rows))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(7)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shuffle_into_shards(df, 7, seed=1).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert sorted(map(repr, sharding.shuffle_into_shards(df, 7, seed=2).collect())) != sorted(map(repr, got))
    assert sharding.shuffle_into_shards(frame(spark, []), 7).count() == 0
    assert {(r.shard, r.slot) for r in sharding.shuffle_into_shards(frame(spark, rows[:3]), 7).collect()} == {(0, 0), (1, 0), (2, 0)}


def test_sharding_is_uniform(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = sharding.shuffle_into_shards(df, 10, min_buckets=16).collect()
    early = [r.doc_id for r in got if r.shard == 0]
    assert len(early) == 2000 and 9000 < sum(early) / len(early) < 11_000
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert abs(sum(a < b for a, b in zip(order, order[1:])) / len(order) - 0.5) < 0.02


def test_sharding_writes_slots_in_order(spark, tmp_path):
    out = sharding.shuffle_into_shards(frame(spark, documents()), 3)
    sharding.write_shards(out, f"file://{tmp_path}/shards")
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert back.count() == len(documents()) and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2}


def key_of(line):
    return line.strip(SPACE).translate(FOLD)


def brute_lines(rows):
    holders = defaultdict(set)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            holders[key_of(line)].add(i)
    last = lambda i: (i is None, i or 0)
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key_of(x)) >= 10 and len(holders[key_of(x)]) >= 2 and min(holders[key_of(x)], key=last) != i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(map(repr, out))


def digest(df):
    return sorted(repr(tuple(r)) for r in df.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)).collect())


def test_line_dedup(spark):
    rows = documents()
    out = line_dedup.dedup_lines(frame(spark, rows).withColumn("n_lines", F.lit(1)))
    no_python(out)
    assert "n_lines_in" in out.columns
    assert digest(out) == brute_lines(rows)
    assert digest(line_dedup.dedup_lines(frame(spark, []))) == []


def test_line_dedup_hot_line(spark):
    rows = [(i, f"one very common line\nline number {i} alone\nOne very COMMON line ", "en", "s", 1) for i in range(1500, 0, -1)]
    df = frame(spark, rows)
    out = line_dedup.dedup_lines(df)
    no_python(out)
    assert digest(out) == brute_lines(rows)
    maps = line_dedup.drop_bitmaps(df)
    assert maps.count() == 1499 and "text" not in maps.columns


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute_hits(rows, items, n=10):
    grams = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - n, 0) + 1):
            if w:
                grams[tuple(w[i : i + n])].add(item)
    sizes = {len(g) for g in grams}
    out = {}
    for i, text, *_ in rows:
        w = words(text)
        hit, found = set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in grams:
                    hit.update(range(a, a + k))
                    found |= grams[tuple(w[a : a + k])]
        ids = sorted(str(x) for x in found if x is not None)
        out[i, text or ""] = (len(w), len(hit), len(ids), ",".join(ids))
    return out


def bench_items(rows):
    long = [r for r in rows if r[1] and len(words(r[1])) > 40]
    some = [(j, " ".join(words(r[1])[5:35])) for j, r in enumerate(long[:6])]
    return [*some, (20, "One two, THREE"), (21, "one"), (22, ""), (23, None), (24, "..."), (None, "x1 x1 x1"), (0, "z" * 70_000), (25, some[0][1]), (25, some[0][1])]


def test_decontamination(spark):
    rows = documents()
    items = bench_items(rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, rows).withColumn("n_words", F.lit(0)).withColumn("spans", F.lit(0))
    for limit in (64 << 20, 20_000):
        hits = decontaminate.find_hits(docs, bench, broadcast_bytes=limit)
        no_python(hits)
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Generate posexplode") > (1 if limit == 20_000 else 0)
        # no words and no texts are shuffled, only hits
        assert "SortMergeJoin" not in plan and not any("ws#" in x for x in plan.split("\n") if "Exchange hashpartitioning" in x)
        tid = {r[0]: (r[1], r[2]) for r in docs.select(F.xxhash64(F.coalesce("text", F.lit(""))), "doc_id", "text").collect()}
        got = {(r.id, tid[r.tid][1] or ""): (r.n_words, r.n, len(r["items"]), ",".join(r["items"])) for r in hits.withColumn("n", decontaminate.hit_words(F.col("spans"))).collect()}
        assert got == brute_hits(rows, items)
    clean = decontaminate.remove(docs, hits)
    bad = {k for k, v in brute_hits(rows, items).items() if v[1]}
    assert bad and sorted(map(repr, ((r.doc_id, r.text) for r in clean.collect()))) == sorted(repr((r[0], r[1])) for r in rows if (r[0], r[1] or "") not in bad)
    cut = decontaminate.remove(docs, hits, "spans")
    for r in cut.collect():
        want = [v for k, v in brute_hits(rows, items).items() if k[0] == r.doc_id][0]
        assert len(words(r.text)) == want[0] - want[1]
    empty = spark.createDataFrame([], "item_id long, text string")
    assert {r.n for r in decontaminate.find_hits(docs, empty).select(F.size("spans").alias("n")).collect()} == {0}
    assert decontaminate.find_hits(spark.createDataFrame([], SCHEMA), bench).count() == 0
