from pyspark.sql import functions as F

from noteloom.operators.graph import blocks_of


def test_blocks_of_a_base(spark):
    rows = spark.createDataFrame([(1,), (2048,), (5000,), (65_536,), (200_000,)], "n long")
    assert [r[0] for r in rows.select(blocks_of(F.col("n"), 16_384)).collect()] == [1, 1, 3, 4, 13]
