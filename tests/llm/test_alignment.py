"""Cross-tokenizer alignment against a plain one with both libraries, text by text."""

import collections
import hashlib
import itertools
import random

from pyspark.sql import functions as F

from trajspark.llm import queries, token_alignment

SF = "/root/testdata/sf0.001"
A, B = queries.tokenizer_path(), queries.tokenizer_path("piece_bpe_32k.model")


def tokens(texts):
    """For each text (ids, end bytes) of both sides; None where the bytes are not those of a space and the text."""
    import json

    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    lib, sp = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    lib.encode_special_tokens = True
    chars = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in chars} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in chars)}
    names = {i: s for s, i in json.loads(lib.to_str())["model"]["vocab"].items()}
    for t in texts:
        a = lib.encode(" " + (t or ""), add_special_tokens=False).ids
        b = sp.encode(t or "")
        x = [bytes(byte[c] for c in names[i]) for i in a]
        y = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, sp.id_to_piece(i)) for i in b)]
        ok = t and b"".join(x) == b"".join(y) == (" " + t).encode()
        yield (list(zip(a, x, strict=True)), list(zip(b, y, strict=True))) if ok else None


def spans(row):
    at = 0
    for i, data in row:
        yield i, at, at + len(data)
        at += len(data)


def brute(rows):
    found, counts = [], collections.Counter()
    for both in tokens([t for _, t in rows]):
        if both is None:
            found.append(None)
            continue
        a, b = (list(spans(r)) for r in both)
        links, j = [], 0
        for i, s, e in a:
            while j and b[j - 1][2] > s:
                j -= 1
            while j < len(b) and b[j][1] < e:
                if b[j][2] > s:
                    links.append((i, b[j][0]))
                j += 1
        counts.update(set(links))
        ends, groups = sorted({e for _, _, e in a} & {e for _, _, e in b}), []
        sides = [collections.deque(side) for side in (a, b)]
        for end in ends:
            own = [[side.popleft()[0] for _ in range(sum(1 for _ in itertools.takewhile(lambda x: x[2] <= end, side)))] for side in sides]
            groups.append("|".join(",".join(map(str, ids)) for ids in own))
        found.append((len(a), len(b), groups, links))
    most = collections.Counter()
    for (i, _), c in counts.items():
        most[i] = max(most[i], c)
    out = []
    for (d, _), f in zip(rows, found, strict=True):
        if f is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((d, f[0], f[1], len(f[2]), len(f[3]), sum(counts[x] == most[x[0]] for x in f[3]), sum(counts[x] for x in f[3]), ";".join(f[2])))
    return out, counts, most


def check(spark, rows):
    got = token_alignment.align_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(brute(rows)[0])


def some(spark, n):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy(F.length("text")).select("doc_id", "text").limit(n).collect()]


def test_documents(spark):
    check(spark, some(spark, 120))


AWKWARD = [(1, None), (2, ""), (3, " "), (4, "  \t\n "), (5, "a"), (5, "a"), (None, "no id"), (6, "▁ looks like ▁a space"), (7, "<s> and <unk> <0x41> <|endoftext|> x"), (8, "naïve 日本語 　wide space ogham \U0001f600 ok"), (9, " leading  double   triple trailing  "), (10, "it's we'll  'tis\r\nnew line 12345 a\x00b \x1c x"), (11, "x" * 3000), (12, "é é ﬁ ½")]


def test_awkward(spark):
    check(spark, AWKWARD)


def test_random_signs(spark):
    rnd = random.Random(3)
    signs = list("ab'  s,.\n\t0é▁日  ​!<>") + ["\U0001f600", "́"]
    check(spark, [(i, "".join(rnd.choice(signs) for _ in range(rnd.randrange(60)))) for i in range(400)])


def test_long_text_and_small_limits(spark, monkeypatch):
    """A text longer than any bound, stripes dealt out over several tasks, counts given out early, entries in many rows."""
    for name, value in {"CHARS": 20_000, "LEAST": 500, "MOST": 500, "PAIRS": 1000, "ENTRIES": 20}.items():
        monkeypatch.setattr(token_alignment, name, value)
    check(spark, [*some(spark, 60), (10**6, " ".join(f"w{i % 997} x{i % 13}" for i in range(60_000)))])


def test_pairs_digest_and_clashing_columns(spark):
    rows = some(spark, 40)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("kind", "batch", "stripe", "at", "a", "b", "n", "doc", "place", "groups", "cell")})
    want, counts, most = brute(rows)
    got = token_alignment.align_documents(df, A, B, digest=True)
    assert sorted(map(tuple, got.collect())) == sorted((*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "") for w in want)
    pairs = token_alignment.pair_counts(df, A, B)
    assert {tuple(r) for r in pairs.collect()} == {(*p, c, c == most[p[0]]) for p, c in counts.items()}
    assert token_alignment.align_documents(df.where("false"), A, B).collect() == []
    assert token_alignment.pair_counts(df.where("false"), A, B).collect() == []
