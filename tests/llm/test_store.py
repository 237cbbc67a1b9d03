"""Token stores that have lost something."""

import shutil

import pytest

from trajspark.llm import queries, token_store


@pytest.fixture
def store(spark, tmp_path):
    text = " ".join(f"w{i % 97}x{i}" for i in range(3000))
    docs = spark.createDataFrame([(1, text), (2, text), (3, "alone")], "doc_id long, text string")
    token_store.write_store(docs, str(tmp_path / "s"), queries.tokenizer_path())
    assert token_store.read_store(spark, str(tmp_path / "s")).count() == 3
    return tmp_path / "s"


def test_missing_chunks(spark, store):
    shutil.rmtree(store / "store/kind=chunk")
    with pytest.raises(Exception, match="do not give its Merkle root"):
        token_store.read_store(spark, str(store)).collect()


def test_missing_documents(spark, store):
    shutil.rmtree(store / "store/kind=own")
    with pytest.raises(ValueError, match="not those of the manifest"):
        token_store.read_store(spark, str(store)).collect()


def test_wide_ids(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(Exception, match="does not fit"):
        token_store.write_store(docs, str(tmp_path / "s"), queries.tokenizer_path(), end_id=70_000)
    token_store.write_store(docs, str(tmp_path / "w"), queries.tokenizer_path(), end_id=70_000, wide=True)
    assert token_store.read_store(spark, str(tmp_path / "w"), wide=True).first().ids[-1] == 70_000
