"""Corpus pipeline over ``documents``: each stage calls one operator of ``quietband.llm``.

Toxic documents go, one document of each near-duplicate group stays, personal data
is masked, sources are mixed to their target weights, and what is left is packed
into token sequences. Every stage works on all rows that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietband.llm.catalog import PACK_END_ID, TOXIC_FROM, WORD_TOKENIZER
from quietband.llm.common import store, table
from quietband.llm.jaccard_join import jaccard_components
from quietband.llm.mixing import mixed_documents
from quietband.llm.packing import harmonic_pack, tokenized_pieces
from quietband.llm.pii import SpanModel, redact
from quietband.llm.toxicity import ToxicityModel

# Bits of the map of documents that may have to go: 8 MB at most, whatever the corpus.
MARK_BITS = 1 << 26


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold.

    NULL and empty texts are scored like others; repeated rows share their fate. An empty
    table stays empty.
    """
    model = ToxicityModel.fit(docs, table(spark, sf_dir, "labels"))
    return model.keep_below(docs, TOXIC_FROM)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group of rows with linked texts.

    Rows are numbered and decided one by one, so ids may repeat or be NULL; rows whose
    text is NULL, empty or without words always stay. An empty table stays empty.
    """
    names = [f"k{i}" for i in range(len(docs.columns))]  # columns may have any name
    text = names[docs.columns.index("text")]
    rows = store(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()), "numbered")
    groups = jaccard_components(rows.select("row", F.col(text).alias("text")), id_col="row")
    gone = store(groups.where(F.col("row") != F.col("component_id")).select("row"), "gone")

    # A bit map of fixed size lets all texts that stay pass without a shuffle.
    bit = lambda: F.pmod(F.xxhash64("row"), F.lit(MARK_BITS))
    flag = lambda: F.call_function("shiftleft", F.lit(1).cast("long"), (bit() % 64).cast("int"))
    words = gone.groupBy(F.shiftright(bit(), 6).alias("word")).agg(F.bit_or(flag()).alias("bits"))
    looked = (
        rows.withColumn("word", F.shiftright(bit(), 6))
        .join(F.broadcast(words), "word", "left")
        .withColumn("suspect", F.coalesce("bits", F.lit(0)).bitwiseAND(flag()) != 0)
    )
    clear = looked.where(~F.col("suspect")).select(*names)
    stays = looked.where("suspect").join(gone, "row", "left_anti").select(*names)
    return clear.unionByName(stays).toDF(*docs.columns)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; ``n_chars`` follows the new text.

    NULL texts and their ``n_chars`` stay as they are, and so does an empty table.
    """
    masked = redact(docs, SpanModel.fit(docs))
    if "n_chars" not in docs.columns:
        return masked
    kind = docs.schema["n_chars"].dataType
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them.

    NULL sources are a source of their own, documents without words are not taken;
    repeated rows are taken one by one. An empty table stays empty.
    """
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with where each piece lies.

    NULL and empty texts hold the end token alone; an empty table gives no pieces.
    """
    return harmonic_pack(tokenized_pieces(docs, WORD_TOKENIZER, PACK_END_ID))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("private_data", mask_private),
    ("mixing", mix),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each one's result stored and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
