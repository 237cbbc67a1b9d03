"""The pretoken table against the tokenizers library, on texts made of what its pretokenizer tells apart."""

import random

import pytest

from trajspark.llm import bpe, queries

PARTS = ["a", "b", "s", "t", "re", "ve", "m", "ll", "d", "'", " ", "  ", "\n", "\t", "1", "23", ",", "!!", "é", "ñ", "×", "÷", "’", "—", "…", " ", "日本", "\0", "\x1f", "\r\n", "\v", "A", "Zz", "ß", "ȿ", "ɀ", "'s", "don't", "<|endoftext|>", " ", "²", "﻿", "x" * 20]


@pytest.mark.parametrize("limit", [1_200_000, 500])
def test_encode(limit):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(20_000)]
    code = bpe.Codec(queries.tokenizer_path(), memo=limit, chunk=40)
    want = [e.ids for e in code.lib.encode_batch_fast(texts, add_special_tokens=False)]
    for i in range(0, len(texts), 700):
        part = slice(i, i + 700)
        assert [x.tolist() for x in code.encode(texts[part])] == want[part]
        assert [x.tolist() for x in code.encode_chunked(texts[part])] == want[part]
    assert code.pretokens.known <= limit + 40_000
    assert [x.tolist() for x in code.encode(["", "a"])] == [[], want and code.lib.encode("a").ids]


def test_other_tokenizers():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.Codec(queries.tokenizer_path("word_bpe_49k.json"))
