"""Masks to index: the samples are evaluated once, however many splits and passes read them."""

import pyarrow as pa
from pyspark.sql import functions as F

from trackhouse.plans import segmentation


def test_pack_and_index_evaluates_samples_once(spark, tmp_path):
    n, seen = 24, str(tmp_path / "seen")
    (tmp_path / "seen").mkdir()

    def look(batches):
        import os
        import uuid

        for b in batches:
            if b.num_rows:
                open(os.path.join(seen, f"{uuid.uuid4().hex}-{b.num_rows}"), "w").close()
            yield pa.RecordBatch.from_pydict({"id": b.column(0)})

    rows = spark.range(0, n, 1, 4).mapInArrow(look, "id long").select(
        F.when(F.col("id") % 4 == 0, "val").otherwise("train").alias("split"), F.lpad(F.col("id").cast("string"), 3, "0").alias("key"),
        (F.col("id") % 3).cast("string").alias("sequence"), F.encode(F.lit("i"), "utf-8").alias("image"),
        F.expr("unhex('1e3c3c')").alias("mask"), F.lit(3).alias("width"), F.lit(1).alias("height"),
    )
    lut = spark.createDataFrame([(30, 0), (60, 1)], "level3_id int, train_id int")
    index = segmentation.pack_and_index(rows, lut, str(tmp_path / "out"), ("train", "val"), range(2), per_shard=4)
    found = {(r.split, r.train_id): (r.pixels, r.samples, r.shards) for r in index.collect()}
    assert found == {("train", 0): (18, 18, 5), ("train", 1): (36, 18, 5), ("val", 0): (6, 6, 2), ("val", 1): (12, 6, 2)}
    assert sum(int(p.name.rpartition("-")[2]) for p in (tmp_path / "seen").iterdir()) == n
