"""The document pipeline: five stages, each written as Parquet and read again by the next.

A stage takes ``(spark, docs, sf_dir)``.  All but the last return the columns of documents, ``doc_id, text, lang,
source, n_chars``, and no others: extra columns of ``docs`` are left out, whatever their names.  Every stage works on
whole texts of all rows, takes an empty table (and returns none), and is deterministic, so a rerun agrees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bibliolith.llm.byte_repeats import remove_repeated_bytes
from bibliolith.llm.jaccard import similar_components
from bibliolith.llm.mixing import mix_sources
from bibliolith.llm.packing import pack_documents
from bibliolith.llm.queries import PASSAGE_BYTES, TOXIC_AT, tokenizer_file
from bibliolith.llm.store import Scratch
from bibliolith.llm.toxicity import fit_toxicity, score_toxicity
from bibliolith.session import ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score stays under the threshold; learned from labelled rows of ``docs``.

    A null or empty text is scored by the bias alone; very long texts are scored whole; equal texts have equal
    scores, so repeated rows stay or go together; a score at the threshold goes; null ids are scored, not learned
    from.  Without labels of both kinds every score is the share of toxic ones among them.
    """
    ship_package(spark)
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs.select(*COLUMNS), model, score_col="_toxicity").where(F.col("_toxicity") < TOXIC_AT).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the least id.

    Null, empty and word-less texts have no copies and stay, except that rows equal in id and text are one.  Rows
    that share an id, or have none, are told apart by their texts, so unlike texts all stay; in a group with such rows
    one of them is kept, by the least hash of id and text; among rows equal in both, the least in the other columns.
    """
    ship_package(spark)
    docs = docs.select(*COLUMNS)
    shared = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias("_id"), F.lit(True).alias("_shared"))
    one_of_its_own = shared.isEmpty()
    node = F.col("doc_id")
    if not one_of_its_own:
        marked = docs.join(shared, docs.doc_id.eqNullSafe(F.col("_id")), "left").drop("_id")
        hashed = -F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.col("text").isNull()), 1) - 1
        docs = Scratch(spark).write(marked.withColumn("_node", F.when(F.col("_shared"), hashed).otherwise(node)))
        node = F.col("_node")
    found = similar_components(docs.select(node.alias("_node"), "text"), n=5, percent=80, id_col="_node")
    copies = found.where("_node <> component_id").select("_node").distinct()
    kept = docs.withColumn("_node", node).join(copies, "_node", "left_anti")
    if not one_of_its_own:
        order = Window.partitionBy("_node").orderBy("lang", "source", "n_chars")
        several = kept.where("_shared").withColumn("_place", F.row_number().over(order)).where("_place = 1")
        kept = kept.where("_shared is null").select(*COLUMNS).unionByName(several.select(*COLUMNS))
    return kept.select(*COLUMNS)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with their texts cut of the strings of ``PASSAGE_BYTES`` bytes that start anywhere else; ``n_chars`` follows.

    The length is less than the 400 bytes of operator 10's query, so that passages of over 50 words go.  All
    occurrences go, the first included; repeated rows of that length thus lose their text.  A null text becomes empty;
    null and repeated ids are kept as they are.
    """
    ship_package(spark)
    cleaned = remove_repeated_bytes(docs, length=PASSAGE_BYTES, rest=("lang", "source"), keep_text=True)
    text = F.col("kept_text")
    return cleaned.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, 0 to 3 times.

    Sizes are words; a null text, or one without words, has size 0 and is not taken.  Null sources are one source.  The
    seeded order is by id, so rows of one id stand together, and its ties are broken by size and checksum of the text; of
    equal rows it doesn't matter which is taken once more.
    """
    mixed = mix_sources(docs, max_epochs=3, keep=("text", "lang", "source", "n_chars"))
    times = F.explode(F.sequence(F.lit(1), F.col("repetitions").cast("int")))
    return mixed.where(F.col("repetitions") > 0).withColumn("_copy", times).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of at most 4096 tokens, see ``pack_documents``.

    A null or empty text is its end token alone; repeated rows and rows without an id are packed each for itself; a
    text of any length is cut into pieces.
    """
    ship_package(spark)
    return pack_documents(docs.select(*COLUMNS), tokenizer_file())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("suffix_dedup", drop_repeated_strings),
    ("mixing", mix),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    before = None
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
