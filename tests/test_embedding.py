import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlab.operators import embedding
from reviewlab.operators.embedding import (
    HashedTfEmbedder,
    ModelEmbedder,
    embed,
    embed_cached,
    lookup_embeddings,
    missing_texts,
    pool,
)
from reviewlab.operators.joins import lookup_join


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, text) for i, text in enumerate(["good clean room", "bad room", "good clean room", "", "bad bad bad food"])]
    return spark.createDataFrame(rows, "row_id int, review string")


def test_user_model_is_pooled(texts):
    def load():
        def model(batch):
            # Two positions of width two: what the first position holds differs from the mean.
            return np.array([[[len(t), 0], [0, len(t)]] for t in batch], dtype="float32")

        return model

    first = {r.row_id: list(r.embedding) for r in embed(texts, ModelEmbedder(load, batch_size=2)).collect()}
    mean = {r.row_id: list(r.embedding) for r in embed(texts, ModelEmbedder(load, pool="mean")).collect()}
    assert first[1] == [8.0, 0.0] and mean[1] == [4.0, 4.0]
    capped = {r.row_id: list(r.embedding) for r in embed(texts, ModelEmbedder(load, max_tokens=2)).collect()}
    assert capped[4] == [7.0, 0.0] and first[4] == [16.0, 0.0]
    with pytest.raises(ValueError):
        pool(np.zeros((1, 1, 1)), "last")


def test_hashed_vectors(texts):
    raw = {r.row_id: np.array(r.embedding) for r in embed(texts, HashedTfEmbedder(32, normalise=False)).collect()}
    assert all(len(v) == 32 for v in raw.values())
    assert raw[0].sum() == 3 and raw[3].sum() == 0 and raw[4].max() == 3 and (raw[0] == raw[2]).all()
    unit = {r.row_id: np.array(r.embedding) for r in embed(texts, HashedTfEmbedder(32)).collect()}
    assert np.allclose([np.linalg.norm(unit[i]) for i in (0, 1, 4)], 1)
    fitted = HashedTfEmbedder(32, normalise=False).fit(texts.where("row_id < 2"))
    weighted = {r.row_id: np.array(r.embedding) for r in embed(texts, fitted).collect()}
    # "room" is in both training texts: its idf is 0, so one non-zero entry is left of "bad room".
    assert (weighted[1] > 0).sum() == 1 and (weighted[0] > 0).sum() == 2


def test_store_is_filled_once(spark, texts, tmp_path):
    path = str(tmp_path / "vectors")
    calls = spark.sparkContext.accumulator(0)

    def load():
        def model(batch):
            calls.add(len(batch))
            return np.array([[len(t)] for t in batch], dtype="float32")

        return model

    embedder = ModelEmbedder(load, max_tokens=None)
    rows = embed_cached(texts.where("row_id < 3"), embedder, path, "length").collect()
    assert {r.row_id: r.embedding[0] for r in rows} == {0: 15.0, 1: 8.0, 2: 15.0} and calls.value == 2
    rows = embed_cached(texts, embedder, path, "length").collect()
    assert len(rows) == 5 and calls.value == 4
    store = spark.read.parquet(f"{path}/length")
    assert store.count() == 4 and missing_texts(texts, store).count() == 0
    assert lookup_embeddings(texts, store).count() == 5


def test_stores_of_different_embedders_do_not_mix(spark, texts, tmp_path):
    path = str(tmp_path / "vectors")
    for width in (8, 16):
        rows = embed_cached(texts, HashedTfEmbedder(width), path, f"hashed-{width}").collect()
        assert {len(r.embedding) for r in rows} == {width}
    # A second append of the same vectors, as after a retried run, does not multiply rows.
    spark.read.parquet(f"{path}/hashed-8").write.mode("append").parquet(f"{path}/hashed-8")
    assert embed_cached(texts, HashedTfEmbedder(8), path, "hashed-8").count() == 5


def test_null_texts_and_unknown_keys_keep_their_rows(spark, texts, tmp_path):
    rows = texts.union(spark.createDataFrame([(9, None)], texts.schema))
    found = embed_cached(rows, HashedTfEmbedder(8), str(tmp_path / "v"), "h").collect()
    assert {r.row_id for r in found} == {0, 1, 2, 3, 4, 9}
    assert [r.embedding for r in found if r.row_id == 9] == [None]


def test_lookup_join_is_whole_with_hot_keys(spark):
    rows = spark.range(100).select(F.when(F.col("id") < 60, 0).otherwise(F.col("id")).alias("k"), "id")
    table = spark.range(0, 95).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = {(r.id, r.k, r.v) for r in lookup_join(rows, table, "k").collect()}
    assert got == {(i, k, 2 * k if k < 95 else None) for i in range(100) for k in [0 if i < 60 else i]}


def test_batches_of_runs_are_lists_over_one_array():
    import pyarrow as pa

    buckets = pa.array([[0, 1, 1], None, [], [2]], pa.list_(pa.int32())).slice(0, 4)
    assert embedding._counts(buckets.slice(1), 3).tolist() == [[0, 0, 0], [0, 0, 0], [0, 0, 1]]
    found = np.arange(24.0).reshape(4, 2, 3)
    lists = embedding._lists(found, buckets)
    assert lists.to_pylist() == [None if i == 1 else found[i].tolist() for i in range(4)]
    assert lists.values.values.buffers()[1].address == found.ctypes.data
