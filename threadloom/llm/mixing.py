"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is a share of all words by its weight, at most ``most_epochs`` times its own words; what that
leaves is shared anew. A source gives whole epochs first. Of the rest it gives the documents with the smallest
exponential keys ``-ln(u) / weight``, where a document's weight is its quality: sorted by key, sizes are summed up
until the budget is met. Sorting and sums go by range partitions, so no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.components import with_found
from threadloom.operators.ranks import placed
from threadloom.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
SALTS = 16


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def quality_weights(labels: DataFrame) -> DataFrame:
    """``labels(doc_id, quality)``, quality from 0 to 1 -> ``(doc_id, weight)``: 0.5 to 2 by the mean of a document's labels. A document without a label weighs 1."""
    rated = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
    return rated.groupBy("doc_id").agg((0.5 + 1.5 * F.avg("quality")).alias("weight"))


def drawn(docs: DataFrame, weights: DataFrame | None, seed: int) -> DataFrame:
    """``(doc_id, source_key, size, key, tie)`` per document; the random number is a checksum of seed, id and text, so reruns agree.

    ``source_key`` tells a null source from all others. Weights meet their documents in ``SALTS`` parts, so an id that many rows repeat is dealt out.
    They do so by a sort-merge join: Spark's estimate of their size leaves the ``SALTS`` copies out, and a broadcast would pass all of them through the driver.
    """
    digest = F.md5(F.concat_ws("-", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))
    source = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("k"), F.col("source").cast("string")))
    part = lambda a, n: F.conv(F.substring("digest", a, n), 16, 10).cast("long")
    rows = docs.select("doc_id", source.alias("source_key"), word_count(F.col("text")).alias("size"), digest.alias("digest"))
    rows = rows.select("doc_id", "source_key", "size", part(1, 13).alias("draw"), part(14, 15).alias("tie"))
    weight = F.lit(1.0)
    if weights is not None:
        salted = weights.select("doc_id", "weight", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")).hint("merge")
        named = rows.where("doc_id IS NOT NULL").withColumn("salt", F.pmod("tie", F.lit(SALTS)).cast("int")).join(salted, ["doc_id", "salt"], "left").drop("salt")
        rows = named.unionByName(rows.where("doc_id IS NULL").withColumn("weight", F.lit(None).cast("double")))
        weight = F.coalesce("weight", F.lit(1.0))
    key = -F.ln((F.col("draw") + 0.5) / float(1 << 52)) / weight
    return rows.select("doc_id", "source_key", "size", key.alias("key"), "tie")


def targets(sources: DataFrame, share: float, weights: tuple[int, ...], most_epochs: int) -> DataFrame:
    """``sources(source_key, words)`` -> ``(source_key, words, target)``.

    Weights repeat over the sources in code point order, null last. ``share`` of all words is dealt by weight among the sources below
    their most, until none is above it; each round is one aggregate over the sources, and caps at least one more.
    """
    numbered = placed(sources, "place", (F.col("source_key") == "n").cast("int"), F.col("source_key"))
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    table, _ = materialize(numbered.select("source_key", "words", weight.alias("weight"), (most_epochs * F.col("words")).alias("most")), "mix-sources")
    words = table.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    capped, level = -1, 0.0
    while True:
        below = F.col("most") >= F.lit(level) * F.col("weight")
        n, held, free = table.agg(F.count(F.when(~below, 1)), F.coalesce(F.sum(F.when(~below, F.col("most"))), F.lit(0)), F.coalesce(F.sum(F.when(below, F.col("weight"))), F.lit(0))).first()
        if n == capped:
            return table.select("source_key", "words", F.least(F.col("most").cast("double"), F.lit(level) * F.col("weight")).alias("target"))
        capped, level = n, (share * words - held) / free if free else float(most_epochs * words)


def mix(docs: DataFrame, labels: DataFrame | None = None, share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), most_epochs: int = 2, seed: int = 0) -> DataFrame:
    """``docs(doc_id, text, source)`` -> ``(doc_id, size, source_size, target, taken)``; ``labels(doc_id, quality)`` are optional.

    ``taken`` is ``size`` times the epochs the mix has of the document. Documents go in whole, so a source misses its target by half of the
    document at its edge at most. Null texts have size 0, are there and give nothing; a null source is one like any other,
    last in order. Rows that repeat an id stand for themselves; equal rows may differ in ``taken``, and which of them
    gives more doesn't matter. Null ids have no label. Other columns are ignored. An empty table gives an empty result.
    """
    rows, _ = materialize(drawn(docs, quality_weights(labels) if labels is not None else None, seed), "mix-rows")
    sizes, _ = materialize(rows.groupBy("source_key").agg(F.sum("size").alias("words"), F.count("*").alias("_rows")), "mix-sizes")
    aims = targets(sizes.select("source_key", "words"), share, weights, most_epochs).join(sizes.select("source_key", "_rows"), "source_key")
    epochs = F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0).cast("long")
    aim = F.struct("words", "target", epochs.alias("epochs"), (F.col("target") - epochs * F.col("words")).alias("budget"))
    known, _ = materialize(aims.select("source_key", aim.alias("aim"), "_rows"), "mix-aims")
    order = ("source_key", "key", "tie", "_row")
    ordered = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    inside = Window.partitionBy("_part", "source_key").orderBy("key", "tie", "_row")
    summed, _ = materialize(ordered.select("doc_id", "source_key", "size", "_part", F.sum("size").over(inside).alias("upto")), "mix-ordered")
    parts = summed.groupBy("_part", "source_key").agg(F.sum("size").alias("_size"), F.count("*").alias("_rows"))
    before = F.sum("_size").over(Window.partitionBy("source_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select(F.concat_ws("-", "_part", "source_key").alias("stretch"), F.coalesce(before, F.lit(0)).alias("start"), "_rows")
    met = with_found(summed.select("doc_id", "source_key", "size", "upto", F.concat_ws("-", "_part", "source_key").alias("stretch")), starts, "stretch", "start")
    aimed = with_found(met.select("doc_id", "source_key", "size", (F.col("start") + F.col("upto") - F.col("size")).alias("ahead")), known, "source_key", "aim")
    chosen = F.when(F.col("ahead") + F.col("size") / 2 <= F.col("aim.budget"), 1).otherwise(0)
    return aimed.select("doc_id", "size", F.col("aim.words").alias("source_size"), F.col("aim.target").alias("target"), (F.col("size") * (F.col("aim.epochs") + chosen)).alias("taken"))
