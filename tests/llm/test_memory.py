"""What keeps the memory of an executor and its Python workers small."""

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from peeratlas.llm.batches import small_batches
from peeratlas.llm.components import components
from peeratlas.llm.kernel_lid import Kernel


def test_texts_reach_python_in_batches_of_about_a_mb(spark):
    fresh = spark.newSession()
    small_batches(fresh)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    texts = fresh.range(0, 3000, 1, 1).select(F.repeat(F.lit("word "), 400).alias("text"))
    found = [r["n"] for r in texts.mapInArrow(sizes, "n long").collect()]
    assert sum(found) >= 3000 * 2000 and max(found) < 2 << 20


def test_no_edges_start_no_rdd_workers(spark, monkeypatch):
    def never(*_, **__):
        raise AssertionError("createDataFrame runs Python workers beside those of the stages")

    edges = spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
    monkeypatch.setattr(SparkSession, "createDataFrame", never)
    found = components(edges)
    assert found.dtypes == [("id", "bigint"), ("root", "bigint")] and found.isEmpty()


def test_packed_presence_is_the_row_of_presence():
    kernel, text = Kernel(), "Größe, and one more.".encode()
    row = np.zeros(1 << kernel.bits, np.uint8)
    kernel.presence(text, row)
    assert kernel.packed(text) == np.packbits(row).tobytes() and row.any()
