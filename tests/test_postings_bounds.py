import random
import tracemalloc

import pyarrow as pa

from noteloom.operators import postings as P


def test_a_task_holds_few_blocks(spark):
    chunks = spark.range(200).selectExpr("id AS chunk_id", "'some text' AS content")
    index = P.build_postings(chunks, block_chunks=5)
    assert index.blocks.select("block").distinct().count() > 20
    assert spark.read.parquet(f"{index.path}/layout").first()["buckets"] == 20  # the 4 shuffle partitions before


def test_windows_take_little_memory():
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcdefgh ", k=200)) for _ in range(5000)]
    table = pa.table({"chunk_id": pa.array(range(5000), pa.int64()), "kb_id": ["x"] * 5000, "text": texts, "block": pa.array([0] * 5000, pa.int32())})
    schema = pa.schema([
        ("block", pa.int32()), ("gram", pa.string()), ("places", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32())),
        ("chunk_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("kb_ids", pa.list_(pa.string()))])
    index = P._index_block("text", schema)
    tracemalloc.start()
    index(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 55 * 1_000_000  # bytes a code point
