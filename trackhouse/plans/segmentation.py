"""From pixel counts per image and label id to the shard index: gate, collapse, count, weigh."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackhouse.operators import histograms, taxonomy
from trackhouse.session import released, stored
from trackhouse.sources.shards import SAMPLES_PER_SHARD, pack

#: Offending files that an error names; it always tells how many there are.
LISTED = 20
#: Rows of counts in a task, of which most may be images of their own.
TASK_ROWS = 1_000_000


def require_known(counts: DataFrame, lut: DataFrame, path: str, id_col: str = "level3_id") -> DataFrame:
    """``counts`` again, or an error if some hold ids outside the lookup table."""
    unknown = taxonomy.unknown_ids(counts, lut, path, id_col)
    shown = [f"{r[0]}: {r[1]}" for r in unknown.orderBy(path, id_col).limit(LISTED).collect()]
    if shown:
        raise ValueError(f"{unknown.count()} images hold ids outside the taxonomy, e.g. {', '.join(shown)}")
    return counts


def collapse(counts: DataFrame, lut: DataFrame, id_col: str = "level3_id") -> DataFrame:
    """Counts per image and train id from counts per image and label id."""
    rest = [c for c in counts.columns if c not in (id_col, "n")]
    return taxonomy.apply_lut(counts, lut, id_col).groupBy(*rest, "train_id").agg(F.sum("n").alias("n"))


def shard_index(
    counts: DataFrame,
    lut: DataFrame,
    classes: Sequence[int],
    *,
    train: object = "train",
    per_shard: int = SAMPLES_PER_SHARD,
    checked: bool = True,
) -> DataFrame:
    """One row per split and class: ``pixels``, ``frequency``, the class's ``weight``, and the
    split's ``samples``, ``sequences``, ``shards`` and ``ignore_pixels``.

    ``counts`` has one row per image and label id: ``split, sequence, key, level3_id, n``. Weights
    come from the ``train`` split alone and are the same in every split; a class that it lacks gets
    the capped weight. Every split has a row for every class.
    """
    if checked:
        require_known(counts, lut, "key")
    # Dealt by image first: aggregates before an exchange would hold nearly every row of a scan's task.
    tasks = max(counts.sparkSession.sparkContext.defaultParallelism, -(-counts.count() // TASK_ROWS))
    per_image = collapse(counts.repartition(tasks, "split", "sequence", "key"), lut)
    splits = histograms.split_summary(per_image).withColumn("shards", F.ceil(F.col("samples") / per_shard).cast("bigint"))
    pixels = per_image.where(F.col("train_id") != taxonomy.IGNORE_ID).groupBy("split", "train_id").agg(F.sum("n").alias("n"))
    every = splits.select("split", F.explode(F.array(*[F.lit(c) for c in classes])).alias("train_id"))
    full = every.join(pixels, ["split", "train_id"], "left").na.fill(0, ["n"])
    weights = histograms.class_weights(full.where(F.col("split") == F.lit(train))).select("train_id", "weight")
    shares = histograms.frequencies(full, ["split"]).withColumnRenamed("n", "pixels")
    return (
        shares.join(weights, "train_id", "left")
        .join(splits.select("split", "samples", "sequences", "shards", "ignore_pixels"), "split")
        .select("split", "train_id", "pixels", "frequency", "weight", "samples", "sequences", "shards", "ignore_pixels")
    )


def packed_index(packed: DataFrame, classes: Sequence[int], *, train: object = "train") -> DataFrame:
    """The shard index of splits from what was packed: ``packed`` has ``split`` and the columns that
    ``shards.pack`` gives. As ``shard_index``, with ``bytes`` and the file ``pattern`` of every split."""
    totals = packed.groupBy("split").agg(
        F.sum("samples").alias("samples"), F.count(F.lit(1)).alias("shards"), F.sum("bytes").alias("bytes"), F.sum("ignore_pixels").alias("ignore_pixels")
    )
    seen = packed.select("split", F.explode("sequences").alias("sequence")).distinct().groupBy("split").agg(F.count(F.lit(1)).alias("sequences"))
    last = F.lpad((F.col("shards") - 1).cast("string"), 5, "0")
    splits = totals.join(seen, "split", "left").na.fill(0, ["sequences"]).withColumn(
        "pattern", F.concat("split", F.lit("/"), "split", F.lit("-{00000.."), last, F.lit("}.tar"))
    )
    train_ids = F.array(*[F.lit(c) for c in classes])
    per_class = packed.select("split", F.explode(F.arrays_zip(train_ids.alias("train_id"), F.col("class_pixels").alias("n"))).alias("p"))
    counts = per_class.groupBy("split", F.col("p.train_id").alias("train_id")).agg(F.sum("p.n").alias("n"))
    weights = histograms.class_weights(counts.where(F.col("split") == F.lit(train))).select("train_id", "weight")
    shares = histograms.frequencies(counts, ["split"]).withColumnRenamed("n", "pixels")
    return shares.join(weights, "train_id", "left").join(splits, "split").select(
        "split", "train_id", "pixels", "frequency", "weight", "samples", "sequences", "shards", "bytes", "pattern", "ignore_pixels"
    )


def pack_and_index(
    samples: DataFrame, lut: DataFrame, out_dir: str, splits: Sequence[str], classes: Sequence[int], *, per_shard: int = SAMPLES_PER_SHARD, train: str = "train"
) -> DataFrame:
    """Masks to index: each of the named ``splits`` of ``samples`` (``split, key, sequence, image, mask, width, height``) is
    gated, collapsed, counted and packed in one pass, and the index is made from the shards' own counts.

    The samples are written once, as every split ranks their keys and then reads them again: from a source of
    small files that would be opening and decoding each file several times a split. The copy goes at the end."""
    packed, samples = None, stored(samples)
    for split in splits:
        mine = samples.where(F.col("split") == split).drop("split")
        stats = pack(mine, split, out_dir, per_shard=per_shard, lut=lut, classes=classes).withColumn("split", F.lit(split))
        packed = stats if packed is None else packed.unionByName(stats)
    released(samples)
    return packed_index(packed, classes, train=train)
