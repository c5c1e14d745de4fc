"""Operator 10, line dedup: first occurrences among range-partitioned line hashes, in DataFrame operations only.

A line's key is the line stripped of ASCII white space, with A-Z lower-cased. Every key of at least `min_chars` code points
becomes a 128-bit hash. The hashes are dealt out by range (they are uniform, so the range is their leading bits), sorted by
hash, document and position, and each range is read once as a stream that remembers only the first document of the running
hash. What follows in another document is dropped. The result is a bitmap of dropped lines for each document that has any,
compressed to its non-zero 64-bit words, never text; `apply_bitmaps` turns it into the kept text.

Hot keys: a sketch over all lines (`approx_top_k`) finds hashes with more than 1/`hot_share` of the lines. Their rows are
salted by document over ranges of their own; the first document of each salted part then meets the others' in a second,
tiny stream. The salt changes where rows are read, not the result.

Defined cases: a null or empty text is one empty line; documents with the same doc_id count as one document; a null doc_id
comes after all others; repeated rows get equal bitmaps; an empty table gives an empty result; columns named like outputs
come back with `_in`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import lower_ascii, reserve, spread

SPACE = " \t\n\x0b\f\r"
LINES_PER_RANGE, SALTS = 1 << 16, 64


def _lines(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = spread(df.select(id_col, text_col)).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tid"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    keyed = lines.withColumn("key", F.btrim("line", F.lit(SPACE))).filter(F.char_length("key") >= min_chars)
    key = lower_ascii(F.col("key"))
    return keyed.select("id", "tid", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(77), key).alias("h2"))


def drop_bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, hot_share: int = 500) -> DataFrame:
    """(id, tid, dropped): documents with dropped lines only. `dropped` maps a 64-line word's number to its bits (set: dropped)."""
    lines = _lines(df, id_col, text_col, min_chars)
    n, top = lines.agg(F.count(F.lit(1)), F.expr("approx_top_k(h1, 400, 20000)")).first()
    hot = [x["item"] for x in top or [] if x["count"] > max(n // hot_share, 1000)]

    is_hot = F.col("h1").isin(hot) if hot else F.lit(False)
    bits = max(12, (n // LINES_PER_RANGE).bit_length())  # ranges grow in number, not in size
    range_of = F.shiftrightunsigned("h1", 64 - bits)
    salted = F.when(is_hot, range_of * SALTS + F.pmod(F.xxhash64("id"), F.lit(SALTS)) + (1 << bits)).otherwise(range_of)
    dealt = lines.withColumn("range", salted).repartition("range")
    stream = Window.partitionBy("range", "h1", "h2").orderBy(F.col("id").asc_nulls_last(), "tid", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = dealt.withColumn("first", F.first("id").over(stream)).withColumn("drop", ~F.col("id").eqNullSafe(F.col("first")))
    if hot:
        # the firsts of a hot hash's salted parts, at most SALTS documents a hash, are compared among themselves
        rest = seen.filter(F.col("drop") | is_hot)
        own = F.when(F.col("drop"), F.xxhash64("id", "tid", "pos"))
        again = Window.partitionBy("drop", F.coalesce(own, F.col("h1")), F.coalesce(own, F.col("h2"))).orderBy(F.col("id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        seen = rest.withColumn("drop", F.col("drop") | ~F.col("id").eqNullSafe(F.first("id").over(again)))
    gone = seen.filter("drop")
    words = gone.groupBy("id", "tid", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits"))
    return words.groupBy("id", "tid").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def apply_bitmaps(df: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's columns plus n_lines, n_dropped and kept_text."""
    df = reserve(df, ("n_lines", "n_dropped", "kept_text"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.withColumn("__tid", F.xxhash64(text))
    maps = bitmaps.select(F.col("id").alias("__id"), F.col("tid").alias("__t"), F.col("dropped").alias("__dropped"))
    joined = docs.join(maps, docs[id_col].eqNullSafe(maps["__id"]) & (docs["__tid"] == maps["__t"]), "left")
    kept = F.expr(f"array_join(filter(split(coalesce(`{text_col}`, ''), '\n'), (x, i) -> (shiftright(coalesce(try_element_at(__dropped, shiftright(i, 6)), 0L), i & 63) & 1L) = 0L), '\n')")
    dropped = F.when(F.col("__dropped").isNull(), F.lit(0)).otherwise(F.expr("aggregate(map_values(__dropped), 0, (a, b) -> a + bit_count(b))"))
    return joined.select(
        *df.columns,
        (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        dropped.cast("long").alias("n_dropped"),
        F.when(F.col("__dropped").isNull(), text).otherwise(kept).alias("kept_text"),
    )


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    return apply_bitmaps(df, drop_bitmaps(df, id_col, text_col, min_chars), id_col, text_col)
