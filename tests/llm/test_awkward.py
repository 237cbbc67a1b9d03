"""Words whose hashes are known to meet, columns with the operators' own names, very long texts, the scorer's plain formula."""

import collections
import zlib

import numpy as np
import pytest

import corpus_pipeline
from trajspark.llm import decontamination, quality_model, quality_rules, substring_dedup, suffix_dedup
from trajspark.llm.words import word_names

THUE = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
OTHER = THUE.translate(str.maketrans("ab", "ba"))


def test_names():
    words = ["a", "b", "a\0", "\0a", "abcdefgh", "abcdefghi", "x" * 16, "x" * 17, "x" * 18, THUE, OTHER, "é", "日本語日本語日本語"]
    one, two, edges = word_names([" ".join(words), None, "", "a \t x"])
    assert edges.tolist() == [0, len(words), len(words), len(words), len(words) + 2]
    assert len(set(one[: len(words)].tolist())) == len(set(two[: len(words)].tolist())) == len(words)
    assert (one[-2], two[-2]) == (one[0], two[0])
    assert word_names([])[2].tolist() == [0]


def test_colliding_words(spark):
    same = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{same} {THUE}"), (2, f"{same} {OTHER}"), (3, f"{same} {THUE}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.substring_digests(docs).collect()} == {1: 0, 2: 0, 3: 20}
    long = " ".join(f"v{i}" for i in range(49))
    docs = spark.createDataFrame([(1, f"{THUE} {long}"), (2, f"{OTHER} {long}"), (3, f"{OTHER} {long}")], "doc_id long, text string")
    assert {(r.doc_id, r.n_words) for r in suffix_dedup.repeated_spans(docs).collect()} == {(2, 50), (3, 50)}


@pytest.mark.parametrize("ids", [[1, 2, 2, None], ["b", "a", None, "b"]])
def test_clashing_columns(spark, ids):
    names = ["_rid", "_RID2", "_part", "_at", "_kept", "kept_text", "_id", "_text", "component_id", "kept", "b"]
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{text} tail{k}", "en", *[f"{c}{k}" for c in names]) for k, i in enumerate(ids)]
    kind = "long" if isinstance(ids[0], int) else "string"
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string, lang string, " + ", ".join(f"`{c}` string" for c in names))
    by_tail = {r[3]: r for r in rows}
    cut = substring_dedup.remove_repeats(docs).collect()
    assert {r._rid: tuple(r[3:]) for r in cut} == {k: v[3:] for k, v in by_tail.items()}
    assert sorted(len(r.text.split()) for r in cut) == [1, 1, 1, 61]
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    assert decontamination.decontaminate(docs, bench).count() == 0
    clean = spark.createDataFrame([(1, "other words of an item here")], "item_id long, text string")
    assert {tuple(r) for r in decontamination.decontaminate(docs, clean).collect()} == set(rows)
    assert {tuple(r) for r in corpus_pipeline.quality(spark, docs, "").collect()} <= set(rows)
    near = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert near and set(near) <= set(rows)


def test_very_long_text(spark):
    """More words than 2**20, and a repeated window among them."""
    words = [f"w{i}" for i in range((1 << 20) + 50)]
    words[-3:] = words[:3]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "same " * (1 << 20))], "doc_id long, text string").selectExpr("*", "'en' AS lang")
    got = {r.doc_id: r for r in quality_rules.quality_verdicts(docs).collect()}
    assert (got[1].n_words, got[1].n_repeat_words, got[2].n_repeat_words) == (len(words), 6, 1 << 20)


def test_scorer_against_the_formula():
    """The scorer's tables against features listed one by one."""
    rng = np.random.default_rng(1)
    texts = ["", "a", "a a a b", "naïve naïve 日本語 x", " ".join(rng.choice(["aa", "bb", "ñandú", "cc1"], 300))]
    model = quality_model.train(["good words here", "bad bad bad"] * 4, [1, 0] * 4)

    def feature_ids(text):
        words, out = text.split(), []
        for w in words:
            whole = np.array([zlib.crc32(f"<{w}>".encode())], np.uint64)
            out += quality_model.word_bucket(whole).tolist()
            for n in quality_model.GRAMS:
                marked = f"<{w}>"
                for k in range(len(marked) - n + 1):
                    h = n
                    for c in marked[k : k + n]:
                        h = (h + ord(c)) * 0x9E3779B97F4A7C15 % 2**64
                        h ^= h >> 29
                    out.append((h >> 20) % (quality_model.BUCKETS - 1))
        for a, b in zip(words[:-1], words[1:], strict=True):
            pair = [np.array([zlib.crc32(f"<{w}>".encode())], np.uint64) for w in (a, b)]
            out += quality_model.pair_bucket(*pair).tolist()
        return out

    scorer = quality_model.Scorer(model)
    for text, got in zip(texts, scorer(texts), strict=True):
        ids = feature_ids(text)
        assert collections.Counter(ids) == collections.Counter(quality_model.text_features(text).tolist())
        logit = (sum(float(model[i]) for i in ids) / len(ids) if ids else 0.0) + float(model[-1])
        assert got == pytest.approx(1 / (1 + np.exp(-logit)))
