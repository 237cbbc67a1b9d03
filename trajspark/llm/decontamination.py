"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only.

Texts are lower-cased and parted at all that is no letter or digit. A window of a document has as many words as an item; it
leaks the item if their five-word shingles, weighted by how often they occur, have a similarity (sum of least over sum of
greatest weights) of at least 0.8. Such a window holds a shingle of the item, so windows are laid where a document's
shingle falls on the same shingle of an item of that size. Each distinct window content gets a SimHash fingerprint. The
items' fingerprints are indexed by eight blocks of eight bits, with all values that differ in at most one bit: of two
fingerprints within 15 bits, some block differs in at most one, so the index gives all of them. Alike texts can be further
apart than that, so beside the index every window is held against each item of its size with which it shares a shingle. The
exact similarity decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise, row_ids

SHINGLE, SIMILARITY = 5, 0.8
BLOCKS, WIDTH = 8, 8
RADIUS = 2 * BLOCKS - 1


def plain_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(words: str) -> Column:
    """Five-word shingles as text; ``words`` has to be a column."""
    at = ", ".join(f"{words}[i + {k}]" for k in range(SHINGLE))
    return F.expr(f"if(size({words}) >= {SHINGLE}, transform(sequence(0, size({words}) - {SHINGLE}), i -> concat_ws(' ', {at})), cast(array() as array<string>))")


def simhash(shingles: str) -> Column:
    """64-bit fingerprint of an array column of shingles, repeats counted: a bit is set if it is in over half of the hashes."""
    ones = "aggregate(_h, 0, (a, h) -> a + cast(shiftright(h, b) & 1 as int))"
    return F.expr(f"aggregate(transform(array(transform({shingles}, s -> xxhash64(s))), _h -> aggregate(sequence(0, 63), 0L, (f, b) -> f | if(2 * {ones} > size(_h), shiftleft(1L, b), 0L))), 0L, (x, y) -> y)")


def _block(fp: str, k: int) -> Column:
    return F.expr(f"cast(shiftright({fp}, {WIDTH * k}) & {2**WIDTH - 1} as int)")


def fingerprint_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` (fp, ...) with those of ``right`` (item_fp, ...) whose fingerprints differ in at most ``RADIUS`` bits, each once."""
    flips = F.array(F.lit(0), *[F.lit(1 << b) for b in range(WIDTH)])
    entries = F.array(*[F.struct(F.lit(k).alias("block"), _block("item_fp", k).alias("value")) for k in range(BLOCKS)])
    index = right.withColumn("e", F.explode(entries)).withColumn("flip", F.explode(flips)).select(*right.columns, F.col("e.block").alias("block"), F.expr("e.value ^ flip").alias("value"))
    probes = left.withColumn("e", F.explode(F.array(*[F.struct(F.lit(k).alias("block"), _block("fp", k).alias("value")) for k in range(BLOCKS)]))).select(*left.columns, "e.block", "e.value")
    met = probes.join(broadcast_if_small(index), ["block", "value"]).where(F.expr(f"bit_count(fp ^ item_fp) <= {RADIUS}"))
    # A pair can meet in several blocks; the first block that differs in at most one bit is the one that counts.
    first = F.expr(" + ".join(["0"] + [f"if(bit_count((shiftright(fp, {WIDTH * k}) ^ shiftright(item_fp, {WIDTH * k})) & {2**WIDTH - 1}) <= 1, {1 << (BLOCKS - k)}, 0)" for k in range(BLOCKS)]))
    return met.where(F.floor(F.log2(first)) == BLOCKS - F.col("block")).drop("block", "value")


def shared_pairs(contents: DataFrame, items: DataFrame) -> DataFrame:
    """(content, length, _item, similarity) of all contents (content, length, _s) and items (_key, _item, _iw, _is) of that length with a shingle in common."""
    bag = lambda c: F.expr(f"transform(array_distinct({c}), x -> named_struct('s', x, 'n', size(filter({c}, y -> y = x))))")
    left = contents.select("content", "length", F.size("_s").alias("_n"), F.explode(bag("_s")).alias("e")).select("content", "length", "_n", "e.s", F.col("e.n").alias("_c"))
    right = items.select("_key", "_item", F.size("_iw").alias("length"), F.size("_is").alias("_in"), F.explode(bag("_is")).alias("e")).select("_key", "_item", "length", "_in", "e.s", F.col("e.n").alias("_ic"))
    common = left.join(broadcast_if_small(right), ["length", "s"]).groupBy("content", "length", "_n", "_key", "_item", "_in").agg(F.sum(F.least("_c", "_ic")).alias("_common"))
    return common.select("content", "length", "_item", F.expr("_common / (_n + _in - _common)").alias("similarity"))


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(_rid, id, item, start_word, n_words, similarity): for each document row and item that it leaks, the most similar window, the first of equals.

    Words are counted after normalisation. Null, empty and short texts leak nothing; an item with less than five words is
    too short to tell and is leaked by none. A document shorter than an item is one window. Repeated ids are separate
    documents; items that are repeated or have a null id are reported like any others; other columns are not read; either table
    may be empty.
    """
    items = benchmark.select(F.col(item_col).alias("_item"), plain_words(F.col(item_text_col)).alias("_iw")).withColumn("_is", _shingles("_iw"))
    items = materialise(items.withColumn("item_fp", simhash("_is")).withColumn("_key", F.monotonically_increasing_id()), "items").where("size(_is) > 0")
    places = items.select(F.size("_iw").alias("length"), F.posexplode("_is").alias("offset", "s")).select(F.xxhash64("s").alias("h"), "length", "offset").distinct()
    rows, rid = row_ids(docs.select(id_col, text_col), id_col, text_col)
    rows = rows.select(F.col(rid).alias("_rid"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    at = " || ' ' || ".join(f"_w[i + {k}]" for k in range(SHINGLE))
    hashed = rows.select("_rid", plain_words(F.col("_text")).alias("_w"))
    hashed = hashed.select("_rid", F.size("_w").alias("n"), F.expr(f"if(size(_w) >= {SHINGLE}, transform(sequence(0, size(_w) - {SHINGLE}), i -> xxhash64({at})), null)").alias("_h"))
    # Outer: for an inner explode the optimizer adds a filter below the projection, where words are split anew for each shingle.
    hits = hashed.select("_rid", "n", F.posexplode_outer("_h").alias("pos", "h")).join(broadcast_if_small(places), "h")
    windows = hits.select("_rid", F.expr("greatest(0, least(pos - offset, n - length))").alias("start"), F.expr("least(length, n)").alias("size"), "length").distinct()
    lists = materialise(windows.groupBy("_rid").agg(F.array_sort(F.collect_list(F.struct("start", "size", "length"))).alias("_windows")), "windows")
    texts = rows.join(lists, "_rid").withColumn("_w", plain_words(F.col("_text")))
    laid = texts.select("_rid", "_id", F.expr("if(size(_w) > 0, transform(_windows, v -> named_struct('start', v.start, 'size', v.size, 'length', v.length, 'content', array_join(slice(_w, v.start + 1, v.size), ' '))), null)").alias("v"))
    laid = materialise(laid.select("_rid", "_id", F.explode_outer("v").alias("v")).where("v is not null").select("_rid", "_id", "v.*"), "laid")
    contents = laid.select("content", "length").distinct().withColumn("_w", F.split("content", " ")).withColumn("_s", _shingles("_w"))
    prints = contents.select("content", "length", "_s", simhash("_s").alias("fp"))
    # A window is as long as the item that it may leak: one laid for another item's size says nothing of this one.
    pairs = fingerprint_pairs(prints, items.select("_item", F.size("_iw").alias("item_length"), "_is", "item_fp")).where("length = item_length")
    common = "aggregate(array_distinct(_s), 0, (a, x) -> a + least(size(filter(_s, y -> y = x)), size(filter(_is, y -> y = x))))"
    pairs = pairs.withColumn("_common", F.expr(common)).withColumn("similarity", F.expr("_common / (size(_s) + size(_is) - _common)"))
    alike = pairs.where(F.col("similarity") >= similarity).select("content", "length", "_item", "similarity")
    alike = alike.unionByName(shared_pairs(contents, items).where(F.col("similarity") >= similarity)).distinct()
    best = F.max(F.struct("similarity", (-F.col("start")).alias("start"), "size")).alias("b")
    found = laid.join(alike, ["content", "length"]).groupBy("_rid", "_id", "_item").agg(best)
    return found.select("_rid", F.col("_id").alias(id_col), F.col("_item").alias(item_col), (-F.col("b.start")).alias("start_word"), F.col("b.size").alias("n_words"), "b.similarity")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``docs`` without the rows that leak an item; all columns are kept, whatever their names."""
    rows, rid = row_ids(docs, id_col, text_col)
    found = leaks(rows.select(F.col(rid).alias(id_col), text_col), benchmark, id_col=id_col, text_col=text_col, item_col=item_col, item_text_col=item_text_col)
    return rows.join(found.select(F.col(id_col).alias(rid)).distinct(), rid, "left_anti").select(*docs.columns)
