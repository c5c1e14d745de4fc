"""Operator 4, benchmark decontamination, in DataFrame operations only.

Benchmark items are cut into windows of `n` consecutive normalised words (a shorter item is one window). Their 128-bit
hashes form the broadcast set. Training documents are scanned word by word; because a document can only hold a window where
it holds that window's anchor (its longest word, a stand-in for its rarest), token windows are formed and hashed only
around words of the broadcast anchor set, at the anchor's offsets. That skips windows which cannot hit and none that can.
Each hash hit is verified word for word. Hit intervals of a document are united into hit words; `remove` then drops the
documents, or cuts the spans out of them.

The broadcast sets' bytes are summed first. A benchmark over `broadcast_bytes` is dealt into parts below it, by the hash of
the window, and the documents are scanned once for each: nothing but hits is ever shuffled, neither words nor texts, so frequent
words and long documents cost no more there.

Defined cases: words are runs of 0-9, a-z and non-ASCII after lower-casing A-Z; null texts and texts without words have no
words and no hits; items without words have no windows; items with a null id can hit but are not counted as items; repeated
documents (same doc_id and text) give one row; null doc_ids are kept; only the id and text columns are read, so names that
clash with outputs do no harm; `remove` keeps all columns; empty tables give empty or clean results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import lower_ascii, scratch, spread, stored

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text):
    """The words, with an empty string before or after them where the text starts or ends with separators."""
    return F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS)


def n_words_of(ws):
    return F.size(ws) - F.when(F.element_at(ws, 1) == "", 1).otherwise(0) - F.when((F.size(ws) > 1) & (F.element_at(ws, -1) == ""), 1).otherwise(0)


def benchmark_windows(bench: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, gram, len): one row for each item and distinct window; gram is the array of words."""
    ws = F.filter(words_of(F.col(text_col)), lambda w: w != "")
    items = bench.select(F.col(id_col).cast("string").alias("item"), ws.alias("ws")).filter(F.size("ws") > 0)
    gram = F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("ws") - (n - 1), F.lit(1))), lambda i: F.slice("ws", i, F.lit(n))))
    return items.select("item", gram.alias("gram")).distinct().withColumn("len", F.size("gram"))


def find_hits(docs: DataFrame, bench: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = 64 << 20) -> DataFrame:
    """One row for each document (id and text): id, tid, n_words, spans (array of [from, to) word intervals, as in `words_of`), items (sorted array)."""
    spark = docs.sparkSession
    grams = benchmark_windows(bench, n).groupBy("gram", "len").agg(F.array_sort(F.collect_set("item")).alias("items"))
    longest = F.array_max(F.transform("gram", lambda w, i: F.struct(F.char_length(w).alias("l"), w.alias("w"), i.alias("i"))))
    grams = grams.withColumn("a", longest).select("gram", "len", "items", F.col("a.w").alias("anchor"), F.col("a.i").alias("off"), F.xxhash64("gram").alias("g1"), F.xxhash64(F.lit(5), F.col("gram")).alias("g2"))
    grams = stored(grams, scratch(spark), "grams")
    size = F.octet_length(F.array_join("gram", " ")) + F.octet_length("anchor") + F.octet_length(F.array_join("items", " ")) + F.size("gram") * 8 + F.size("items") * 8 + 64
    parts = max(1, -(-(grams.agg(F.sum(size.cast("long"))).first()[0] or 0) // broadcast_bytes))

    text = F.coalesce(F.col(text_col), F.lit(""))
    base = spread(docs.select(id_col, text_col)).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tid"), words_of(F.col(text_col)).alias("ws"))
    scanned = base.select("id", "tid", "ws", F.posexplode("ws").alias("p", "w"))
    start = F.col("p") - F.col("off")
    fits = F.col("anchor").isNotNull() & (start >= 0) & (start + F.col("len") <= F.size("ws"))
    window = F.when(fits, F.slice("ws", F.greatest(start, F.lit(0)) + 1, F.coalesce("len", F.lit(0))))
    found = None
    for part in range(parts):
        own = grams if parts == 1 else grams.filter(F.pmod("g2", F.lit(parts)) == part)
        # row p = 0 of every document stays in the first scan, hit or not, and carries its number of words
        stays = F.col("p") == 0 if part == 0 else F.lit(False)
        near = scanned.join(F.broadcast(own.select("anchor", "off", "len").distinct()), F.col("w") == F.col("anchor"), "left").filter(F.col("anchor").isNotNull() | stays)
        windows = near.select("id", "tid", "p", F.when(F.col("p") == 0, n_words_of(F.col("ws"))).alias("n_words"), start.alias("start"), "len", window.alias("win"))
        windows = windows.withColumn("w1", F.when(F.col("win").isNotNull(), F.xxhash64("win"))).withColumn("w2", F.when(F.col("win").isNotNull(), F.xxhash64(F.lit(5), F.col("win"))))
        hits = windows.join(F.broadcast(own.select("g1", "g2", "gram", "items")), (F.col("w1") == F.col("g1")) & (F.col("w2") == F.col("g2")) & (F.col("win") == F.col("gram")), "left")
        span = F.when(F.col("gram").isNotNull(), F.struct(F.col("start").alias("from"), (F.col("start") + F.col("len")).alias("to")))
        hits = hits.filter(F.col("gram").isNotNull() | stays).select("id", "tid", "n_words", span.alias("span"), "items")
        found = hits if found is None else found.unionByName(hits)
    return found.groupBy("id", "tid").agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def hit_words(spans):
    """Words in the union of sorted intervals."""
    zero = F.struct(F.lit(0).alias("to"), F.lit(0).alias("n"))
    step = lambda a, s: F.struct(F.greatest(a["to"], s["to"]).alias("to"), (a["n"] + F.greatest(s["to"] - F.greatest(a["to"], s["from"]), F.lit(0))).alias("n"))
    return F.aggregate(spans, zero, step, lambda a: a["n"])


def remove(docs: DataFrame, hits: DataFrame, mode: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without contaminated documents, or (mode `spans`) with their hit words cut out and the rest joined by spaces."""
    bad = hits.filter(F.size("spans") > 0).select(F.col("id").alias("__id"), F.col("tid").alias("__tid"), F.col("spans").alias("__spans"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    same = docs[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__tid"))
    if mode == "documents":
        return docs.join(bad, same, "left_anti")
    if mode != "spans":
        raise ValueError(f"mode is documents or spans, not {mode}")
    joined = docs.join(bad, same, "left")
    tokens = F.regexp_extract_all(text, F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*|^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), 0)
    outside = lambda i: ~F.exists("__spans", lambda s: (s["from"] <= i) & (i < s["to"]))
    cut = F.array_join(F.filter(tokens, lambda w, i: outside(i)), "")
    return joined.select(*[F.when(F.col("__spans").isNull(), F.col(c)).otherwise(cut).alias(c) if c == text_col else F.col(c) for c in docs.columns])
