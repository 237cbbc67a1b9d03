"""Quality rules by distribution divergence, in DataFrame functions only.

Base rules count words, symbols, repeated lines and repeated three-word windows of each text. The method compares two
histograms of a document, its character classes and the common words of its language, with those of all documents of
that language that pass the base rules, by Jensen-Shannon distance. A short text's histogram strays by chance, so each
limit has a part that falls with the square root of the length, and the method judges nothing below a least length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACES, UPPER, ascii_lower, broadcast_if_small, materialise, split_words

#: Frequent function words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that for it with as was on are by".split(),
    "de": "der die und das ein eine in den von zu mit ist im sich auf nicht".split(),
    "fr": "le la les de des du et un une que est en pour dans sur au".split(),
    "es": "el la los las de y que en un una por con para del se su".split(),
}
SYMBOLS = "#*$%&|<>"
CLASSES = {"lower": LOWER, "upper": UPPER, "space": SPACES, "digit": "0123456789", "stop": ".,;:!?", "mark": "'\"()-_/", "symbol": "#*$%&|<>=+@[]{}\\^~`"}
N_WORDS = 16
#: Limits of the two distances: a constant, and a part to be divided by the square root of the counted characters or words.
CHAR_LIMIT, WORD_LIMIT = (0.16, 1.5), (0.02, 3.0)
LEAST_WORDS, BASE_WORDS = 50, 50


def _repeat_words(words: str, n: str) -> list[tuple[str, Column]]:
    """Steps of columns that end in n_repeat_words: words in three-word windows that occur at least twice in the text.

    A window's hash and place share one long, so that a sort of plain numbers brings equal hashes together. Windows whose
    hash has a neighbour are compared as text: sorted with their places, equal neighbours give the places of repeated
    windows, and a fold over those in order adds up the words that they cover. A place takes 31 bits, as many as any array
    has; the 33 bits of hash above it only choose what is compared.
    """
    hashes = F.when(F.expr(f"{n} >= 3"), F.expr(f"sort_array(transform(sequence(0, {n} - 3), i -> shiftleft(shiftright(xxhash64({words}[i], {words}[i + 1], {words}[i + 2]), 31), 31) | i))"))
    same = "shiftright(_hashes[{}], 31) = shiftright(x, 31)"
    candidates = F.expr(f"transform(filter(_hashes, (x, i) -> (i > 0 and {same.format('i - 1')}) or (i + 1 < size(_hashes) and {same.format('i + 1')})), x -> cast(x & 2147483647 as int))")
    windows = F.expr(f"transform(_candidates, i -> struct(concat_ws(' ', {words}[i], {words}[i + 1], {words}[i + 2]) as t, i as i))")
    sorted_windows = F.array_sort(windows)
    twins = F.expr("filter(_sorted, (x, i) -> (i > 0 and _sorted[i - 1].t = x.t) or (i + 1 < size(_sorted) and _sorted[i + 1].t = x.t))")
    places = F.array_sort(F.transform("_twins", lambda x: x["i"]))
    covered = F.expr("aggregate(_places, named_struct('e', 0, 'n', 0L), (a, p) -> named_struct('e', p + 3, 'n', a.n + 3 - greatest(0, a.e - p)), a -> a.n)")
    return [("_hashes", hashes), ("_candidates", candidates), ("_sorted", sorted_windows), ("_twins", twins), ("_places", places), ("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))]


def document_features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Base counts and both histograms of each row; null texts count as empty. One narrow pass over the texts."""
    df = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.lower(lang_col), F.lit("")).alias("_lang"), F.coalesce(text_col, F.lit("")).alias("_text"))
    df = df.withColumn("_w", split_words(F.col("_text"))).withColumn("n_words", F.size("_w").cast("long"))
    for name, c in _repeat_words("_w", "cast(n_words as int)"):
        df = df.withColumn(name, c)
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    df = df.withColumn("_lines", lines).withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    # Each class is taken out of what the classes before it have left, so that later passes are short.
    counts, df = [], df.withColumn("_r0", F.col("_text"))
    for i, (_, chars) in enumerate(CLASSES.items()):
        df = df.withColumn(f"_r{i + 1}", F.translate(f"_r{i}", chars, ""))
        counts.append(F.length(f"_r{i}") - F.length(f"_r{i + 1}"))
    counts.append(F.length(f"_r{len(CLASSES)}"))
    df = df.withColumn("chars", F.array(*counts).cast("array<long>"))
    # What is left after letters and spaces holds all symbols.
    left = F.col("_r3")
    df = df.withColumn("word_chars", F.length("_text") - F.col("chars")[2]).withColumn("n_symbols", (F.length(left) - F.length(F.translate(left, SYMBOLS, ""))).cast("long"))
    lists = F.create_map(*[x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    every = sorted({w for v in COMMON_WORDS.values() for w in v})
    bare = F.filter(F.transform("_w", lambda x: F.rtrim(ascii_lower(x), F.lit(".,;:!?"))), lambda x: x.isin(every))
    df = df.withColumn("_common", bare).withColumn("_list", lists[F.col("_lang")])
    # Named twice, _common stays a column; else the optimizer puts it into the lambda, to be made again for each word.
    df = df.withColumn("_hits", F.expr("if(size(_common) >= 0, transform(_list, w -> cast(size(filter(_common, x -> x = w)) as long)), null)"))
    df = df.withColumn("common", F.expr("array_append(_hits, n_words - aggregate(_hits, 0L, (a, x) -> a + x))"))
    failed = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.select("_id", "_lang", "n_words", F.col("word_chars").cast("long").alias("word_chars"), "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "chars", "common")


def language_references(features: DataFrame) -> DataFrame:
    """Summed histograms of each language over all its documents that pass the base rules."""
    sums = lambda name, n: F.array(*[F.sum(F.col(name)[i]) for i in range(n)]).alias(f"ref_{name}")
    return features.where(~F.col("base_failed")).groupBy("_lang").agg(sums("chars", len(CLASSES) + 1), sums("common", N_WORDS + 1))


def js_distance(name: str) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) between the histograms ``name`` and ``ref_<name>``; null if either is empty."""
    total = lambda c: f"aggregate({c}, 0D, (a, x) -> a + x)"
    pairs = f"zip_with({name}, ref_{name}, (x, y) -> named_struct('p', x / _n_{name}, 'q', y / _m_{name}))"
    term = lambda x: f"if({x} > 0, {x} * log2(2 * {x} / (v.p + v.q)), 0D)"
    fold = F.expr(f"sqrt(greatest(0D, aggregate({pairs}, 0D, (a, v) -> a + {term('v.p')} + {term('v.q')}) / 2))".replace(f"_n_{name}", f"{total(name)}").replace(f"_m_{name}", f"{total('ref_' + name)}"))
    return F.when(F.expr(f"{total(name)} > 0 and {total('ref_' + name)} > 0"), fold)


def quality_verdicts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each row of ``docs``: id, base counts, base_failed, both distances and kept.

    A document of a language without reference documents, or with less than ``LEAST_WORDS`` words, is judged by the base
    rules alone; one without a list of common words, by its characters. Empty and null texts fail the base rules. Repeated rows and null ids are
    judged one by one; an empty table gives an empty result. Features are written once, as both the references and the
    verdicts are made from them.
    """
    features = materialise(document_features(docs, id_col=id_col, text_col=text_col, lang_col=lang_col), "features")
    references = broadcast_if_small(materialise(language_references(features), "references"))
    df = features.join(references, "_lang", "left")
    df = df.withColumn("char_distance", js_distance("chars")).withColumn("word_distance", js_distance("common"))
    chars = F.col("word_chars") + F.col("chars")[2]
    far = lambda name, limit, n: F.coalesce(F.col(name) > limit[0] + limit[1] / F.sqrt(n), F.lit(False))
    bad = (F.col("n_words") >= LEAST_WORDS) & (far("char_distance", CHAR_LIMIT, chars) | far("word_distance", WORD_LIMIT, F.col("n_words")))
    return df.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~bad).alias("kept"), "char_distance", "word_distance")
