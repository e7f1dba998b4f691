"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected the same number of times (target words
over source words). Documents are laid along a line, one step of that length
each, the line is shifted by one random offset, and a document is emitted once
per integer it covers. Documents are laid out by size class, so the words taken
follow the target closely whatever the sizes are. Where a group of documents
starts on the line is known from the counts of the groups before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quietband.llm.common import store, with_rank

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
WORD = r"[^\x20\x09-\x0D]+"
# Groups a size class of a source is split into, and documents per group at large sizes.
MIN_GROUPS = 4
GROUP_DOCS = 10_000_000


def source_targets(
    sources: DataFrame, source: str, size: str, weights=WEIGHTS, most: int = MOST_COPIES
) -> DataFrame:
    """Add ``target`` to one row per source.

    Weights repeat along the sources in code-point order, NULL last. A target stops
    at ``most`` times its source's size and the excess is shared again by weight.
    Only three sums per round reach the driver; the number of sources is free.
    """
    ranked = with_rank(sources, [F.col(source).asc_nulls_last()], "_rank")
    place = (F.col("_rank") % len(weights) + 1).cast("int")
    weighed = store(
        ranked.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), place)).drop("_rank"),
        "weighed",
    )
    share = None
    while True:
        full = F.lit(False) if share is None else F.lit(share) * F.col("_weight") > most * F.col(size)
        row = weighed.agg(
            F.sum(size),
            F.sum(F.when(full, most * F.col(size)).otherwise(0)),
            F.sum(F.when(full, 0).otherwise(F.col("_weight"))),
        ).first()
        total, held, open_weight = (x or 0 for x in row)
        new = (total - held) / open_weight if open_weight else share or 0.0
        if new == share:
            break
        share = new
    target = F.least(F.lit(share) * F.col("_weight"), (most * F.col(size)).cast("double"))
    return weighed.withColumn("target", target).drop("_weight")


def _laid_out(
    docs: DataFrame,
    keep: list[str],
    id_col: str,
    text_col: str,
    source_col: str,
    weights,
    most: int,
    seed: int,
) -> DataFrame:
    """Columns ``keep`` as ``k0``, ``k1``, .. with ``size``, ``source_size``, ``target``, ``copies``."""
    groups = max(MIN_GROUPS, docs.count() // GROUP_DOCS)
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(
        *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)],
        F.col(source_col).isNull().alias("_none"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_source"),
        size.alias("_size"),
        F.xxhash64(F.lit(seed), F.col(id_col), size).alias("_hash"),
    ).withColumn("_class", F.floor(32 * F.log2(F.col("_size") + 1)).cast("int"))
    sized = sized.withColumn("_group", F.pmod("_hash", F.lit(groups)).cast("int"))
    where = ["_none", "_source", "_class", "_group"]
    counted = store(sized.groupBy(*where).agg(F.count("*").alias("_rows"), F.sum("_size").alias("_words")), "sizes")
    sources = counted.groupBy("_none", "_source").agg(F.sum("_words").alias("_source_size"))
    sources = sources.withColumn("_name", F.when(~F.col("_none"), F.col("_source")))
    targets = source_targets(sources, "_name", "_source_size", weights, most).drop("_name")
    line = Window.partitionBy("_none", "_source").orderBy("_class", "_group")
    starts = counted.withColumn("_before", F.sum("_rows").over(line) - F.col("_rows"))
    starts = store(starts.select(*where, "_before").join(targets, ["_none", "_source"]), "lines")
    along = Window.partitionBy(*where).orderBy("_size", "_hash")
    rate = F.coalesce(F.try_divide("target", "_source_size"), F.lit(0.0))
    offset = F.pmod(F.xxhash64(F.lit(seed), "_none", "_source"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    place = F.col("_before") + F.row_number().over(along) - 1
    crossed = F.floor((place + 1) * rate + offset) - F.floor(place * rate + offset)
    return sized.join(starts, where).select(
        *[f"k{i}" for i in range(len(keep))],
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        "target",
        F.least(crossed, F.lit(most)).cast("long").alias("copies"),
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    most: int = MOST_COPIES,
    seed: int = 11,
) -> DataFrame:
    """``(id, size, source_size, target, copies)``, one row per row of ``docs``.

    A NULL or empty text has size 0 and an empty source target 0; NULL is a source of
    its own. The result depends on ids, sizes and the seed alone, not on the
    partitioning; rows that agree in them are interchangeable. Other columns are
    ignored; an empty table gives an empty result.
    """
    return _laid_out(docs, [id_col], id_col, text_col, source_col, weights, most, seed).withColumnRenamed(
        "k0", id_col
    )


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    most: int = MOST_COPIES,
    seed: int = 11,
) -> DataFrame:
    """Rows of ``docs``, each as often as ``mix_sources`` takes it; columns as they came."""
    laid = _laid_out(docs, docs.columns, id_col, text_col, source_col, weights, most, seed)
    copies = F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies")))
    emitted = laid.withColumn("copy", F.explode(copies))
    return emitted.select(*[f"k{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)
