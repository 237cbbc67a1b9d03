"""The training-data operators against brute force, on sf0.001 and on a table of awkward rows."""

import collections
import hashlib
import re
import zlib

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from trajspark.llm import bpe, decontamination, html_extract, quality_model, quality_rules, queries, simhash_dedup, substring_dedup, suffix_dedup, token_store, url_rules

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 997}x{i}" for i in range(3000))
#: Null and empty texts, ties, repeated rows and ids, a null id, a long text, a run of one word.
AWKWARD = [(1, None), (2, ""), (3, " \t\n"), (4, "a b c"), (4, "a b c"), (4, "another text"), (None, "no id " * 9), (5, LONG), (6, LONG[:9000] + " end"), (7, "same " * 60), (8, "<|endoftext|> x <|endoftext|>"), (9, "naïve 日本語 " * 30 + "\u00a0 tail  ")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    """With columns whose names the operators use inside."""
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string")
    return df.select("doc_id", "text", F.lit("en").alias("lang"), *[F.lit(7).alias(c) for c in ("_id", "_rid", "fp", "host", "key", "n_words", "start", "label")])


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.where("false")


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def ordered(df):
    return sorted(rows(df), key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))


def counted(got, want):
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, want))


@pytest.fixture(params=["docs", "awkward", "empty"])
def any_docs(request):
    return request.getfixturevalue(request.param)


def test_bpe(any_docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.tokenizer_path())
    want = []
    for i, t in rows(any_docs):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    counted(bpe.encode_digests(any_docs, queries.tokenizer_path()).collect(), want)
    back = bpe.decode_documents(bpe.encode_documents(any_docs, queries.tokenizer_path()), queries.tokenizer_path())
    counted(back.collect(), [(i, t or "") for i, t in rows(any_docs)])


def test_small_chunks(awkward):
    code = bpe.Codec(queries.tokenizer_path(), chunk=40)
    for _, t in rows(awkward):
        assert code.encode_chunked([t or ""])[0].tolist() == code.lib.encode(t or "", add_special_tokens=False).ids


def test_token_store(spark, any_docs, tmp_path):
    from tokenizers import Tokenizer

    lib, start, want = Tokenizer.from_file(queries.tokenizer_path()), 0, []
    for i, t in ordered(any_docs):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    token_store.write_store(any_docs, str(tmp_path / "s"), queries.tokenizer_path())
    counted(token_store.read_store(spark, str(tmp_path / "s"), digest=True).collect(), want)
    assert token_store.verify_manifest(spark, str(tmp_path / "s"))
    if not want:
        return
    chunks = spark.read.parquet(str(tmp_path / "s/store")).where("kind = 'chunk'")
    assert chunks.count() == chunks.select("hashes").distinct().count()


def test_substrings(any_docs):
    seen, want = set(), []
    for i, t in ordered(any_docs):
        w = WORD.findall(t or "")
        out = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                out[k : k + 20] = [True] * 20
            seen.add(key)
        want.append((i, len(w), sum(out), hashlib.sha256(" ".join(x for x, y in zip(w, out, strict=True) if not y).encode()).hexdigest()))
    counted(substring_dedup.substring_digests(any_docs).collect(), want)
    assert substring_dedup.remove_repeats(any_docs).columns == any_docs.columns


def repeated(texts, n):
    count = collections.Counter(tuple(w[k : k + n]) for w in texts for k in range(len(w) - n + 1))
    return [{p for k in range(len(w) - n + 1) if count[tuple(w[k : k + n])] > 1 for p in range(k, k + n)} for w in texts]


def test_suffixes(docs, empty):
    table = {i: WORD.findall(t or "") for i, t in rows(docs)}
    found = collections.defaultdict(set)
    for r in suffix_dedup.repeated_spans(docs).collect():
        assert r.n_words >= 50
        found[r.doc_id].update(range(r.start_word, r.start_word + r.n_words))
    for i, must, may in zip(table, repeated(table.values(), 50), repeated(table.values(), 40), strict=True):
        assert must <= found[i] <= may
    assert suffix_dedup.repeated_spans(empty).count() == 0


def test_suffixes_awkward(awkward):
    assert {r.doc_id for r in suffix_dedup.repeated_spans(awkward).collect()} == {5, 6, 7, 9}


def fingerprint(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = WORD.findall(low)
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]), 42) for k in range(max(len(w) - 3, 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(any_docs):
    data = rows(any_docs)
    fps = [fingerprint(t) for _, t in data]
    group = list(range(len(data)))
    for a in range(len(data)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4 and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    least = {g: min((d[0] for d, h in zip(data, group, strict=True) if h == g and d[0] is not None), default=None) for g in group}
    counted(simhash_dedup.near_duplicates(any_docs).collect(), [(d[0], f"{f:016x}", least[g]) for d, f, g in zip(data, fps, group, strict=True)])


def test_many_near_copies(spark):
    """A chain of fingerprints a few bits apart, and a crowd within reach of each other."""
    import numpy as np

    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(-(2**62), 2**62, 40)]
    fps = {b ^ (1 << int(k)) ^ (1 << int(m)) for b in base[:3] for k in rng.integers(0, 60, 12) for m in rng.integers(0, 60, 12)} | set(base)
    links = simhash_dedup.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    roots = {r.node: r.root for r in simhash_dedup.components(links).collect()}
    order, group = sorted(fps), {f: f for f in fps}
    for a in order:
        for b in order:
            if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4 and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {f: low if g == high else g for f, g in group.items()}
    assert {f: roots.get(f, f) for f in fps} == group


def test_quality_rules(any_docs):
    got = quality_rules.quality_verdicts(any_docs).collect()
    want = []
    for i, t in rows(any_docs):
        t = t or ""
        w = WORD.findall(t)
        tri = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        rep = len({p for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for p in range(k, k + 3)})
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep, len(w) < 50 or 100 * rep > 50 * len(w)))
    counted([r[:7] for r in got], want)
    assert all(not (r.kept and r.base_failed) for r in got)


def test_quality_rules_verdicts(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    v = quality_rules.quality_verdicts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("not base_failed").join(labels, "doc_id")
    share = {r.quality: r.k for r in v.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[1] > 0.97 and share[0] < 0.3


def test_quality_model(spark, docs, awkward, empty):
    labels, data = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("labels", "documents"))
    model = quality_model.fit(data, labels)
    scored = quality_model.score_documents(data, model).join(labels, "doc_id").where("held_out")
    assert scored.where("predicted = quality").count() >= 0.95 * scored.count()
    got = quality_model.score_documents(awkward, model).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert quality_model.score_documents(empty, model).count() == 0
    assert len({r.score for r in quality_model.score_documents(awkward, quality_model.fit(data, labels.where("false"))).collect()}) == 1


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<p>a &amp; b"), (3, "u", "<nav><a>m</a></nav><article><header><h1>T</h1></header><p>x <b>y</b>z<br>q</p><div class='ad'>buy</div><p>End.</p></article><div class='comments'><p>" + "nice words " * 40 + "</p></div>"), (3, "u", "<script>x")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = {(r.page_id, r.text, r.n_chars) for r in html_extract.extract_pages(pages).collect()}
    assert got == {(1, "", 0), (2, "", 0), (None, "a & b", 5), (3, "T x yz q End.", 13), (3, "", 0)}
    assert html_extract.extract_pages(pages.where("false")).count() == 0


def test_urls(spark):
    con = duckdb.connect()
    urls = ["http://WWW.Example.com/en/1", "https://example.com/en/", "http://x.example.com/en/z?q", "http://example.com", "http://a.net/es/1", "net/es/1", None, "", "http://", "http://com/x#://y", "http://example.com/en/1", "http://xcom/", "http://é.com/ñ"]
    data = [(i // 2, u) for i, u in enumerate(urls)]
    pages = spark.createDataFrame(data, "page_id long, url string").withColumn("host", F.lit("h"))
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", data)
    got = url_rules.filter_urls(pages, rules)
    r = con.execute(queries.ORACLE_SQL["op9_url_filters"])
    counted(got.select([d[0] for d in r.description]).collect(), r.fetchall())
    assert url_rules.filter_urls(pages.where("false"), rules).count() == 0
    assert {r.verdict for r in url_rules.filter_urls(pages, rules.where("false")).collect()} == {"allow"}


def plain(text):
    import regex

    return [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]


def best_windows(docs, items):
    out = {}
    for i, t in docs:
        w = plain(t)
        for k, it in items:
            iw = plain(it)
            size = min(len(iw), len(w))
            a = collections.Counter(tuple(iw[j : j + 5]) for j in range(len(iw) - 4))
            for s in range(len(w) - size + 1) if size >= 5 and len(iw) >= 5 else ():
                b = collections.Counter(tuple(w[j : j + 5]) for j in range(s, s + size - 4))
                if a.keys() & b.keys() and (sim := sum((a & b).values()) / sum((a | b).values())) >= 0.8 and sim > out.get((i, k), (0,))[0]:
                    out[i, k] = (sim, s)
    return out


def test_decontamination(spark, docs, awkward, empty):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in decontamination.leaks(docs, bench).collect()}
    want = best_windows(rows(docs), items)
    assert want and {k: (pytest.approx(v[0]), v[1]) for k, v in want.items()} == got
    long = " ".join(f"w{i % 997}x{i}" for i in range(500, 560))
    near = long.replace("w530x530", "other")
    odd = spark.createDataFrame([(1, long), (1, long), (2, near), (3, None), (4, "a b c"), (None, "no id no id no id"), (5, "w1 " * 9)], "item_id long, text string").withColumn("content", F.lit(1))
    found = {(r.doc_id, r.item_id) for r in decontamination.leaks(awkward, odd).collect()}
    assert found == {(5, 1), (5, 2), (6, 1), (6, 2), (None, None)}
    assert decontamination.leaks(empty, bench).count() == 0 and decontamination.leaks(docs, bench.where("false")).count() == 0
    assert decontamination.decontaminate(docs, bench).count() == docs.count() - len({k[0] for k in want})


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = p.quality(spark, docs, SF)
    verdicts = {r.doc_id for r in quality_rules.quality_verdicts(docs).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == verdicts
    near = p.near_duplicates(spark, kept, SF)
    assert {r.doc_id for r in near.collect()} == {r.component_id for r in simhash_dedup.near_duplicates(kept).collect()}
    cut = p.substrings(spark, near, SF)
    assert cut.columns == docs.columns and cut.count() == near.count() and all(r.n_chars == len(r.text) for r in cut.collect())
    digests = {r.doc_id: (r.n_removed, r.kept_sha256) for r in substring_dedup.substring_digests(near).collect()}
    for r in cut.collect():
        if digests[r.doc_id][0]:
            assert hashlib.sha256(r.text.encode()).hexdigest() == digests[r.doc_id][1]
    clean = p.decontaminate(spark, cut, SF)
    leaked = best_windows(rows(cut), [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in cut.collect()} - {k[0] for k in leaked}
    counted(p.run(spark, SF).collect(), p.encode(spark, clean, SF).collect())
    for _, stage in p.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0


def test_registered():
    import __spark_entry__ as e

    assert {f"op{n}" for n in range(1, 14)} | {"pipeline"} == {q.split("_")[0] for q in e.queries() if q.startswith("op") and q[2].isdigit() or q == "pipeline"}
