"""Training-data pipeline over documents: toxicity, near-dedup, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and keeps the columns of `docs` (the last returns packed pieces).  Null texts are
treated as empty; rows with null ids are kept and count as separate documents; an empty table passes every stage; other
columns keep their values, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.llm import packing, secrets, simhash, suffix_dedup, toxicity
from coppice.plans.lineage import settle, written


def _wrapped(docs: DataFrame) -> DataFrame:
    """(doc_id, text, __rest): all other columns under one name, so that none can clash with an operator's results."""
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"]
    return docs.select("doc_id", "text", F.struct(*others).alias("__rest"))


def _unwrapped(docs: DataFrame, like: DataFrame, changed: bool = False) -> DataFrame:
    """The columns of `like`, the length following the text if that may have `changed`."""

    def column(c: str) -> Column:
        if c.lower() == "text":
            return F.col("text").alias(c)
        if changed and c.lower() == "n_chars":
            return F.char_length("text").cast(like.schema[c].dataType).alias(c)
        return F.col("__rest").getField(c).alias(c)

    return docs.select(*map(column, like.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from labelled rows that aren't held out."""
    rows = _wrapped(docs)
    model = toxicity.train(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _unwrapped(toxicity.score(rows, model).where(F.col("score") < toxicity.THRESHOLD), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest id stays; repeated rows count once."""
    marked = _wrapped(docs).withColumn("__text_hash", F.xxhash64("text"))
    groups = simhash.near_components(marked.select("doc_id", "text", "__text_hash"), root=True)
    least = groups.where("doc_id = component_id").groupBy("root_fp").agg(F.min(F.struct("doc_id", "fp", "__text_hash")).alias("x"))
    first = least.select("x.doc_id", "x.__text_hash")
    one = marked.join(first, ["doc_id", "__text_hash"], "left_semi").dropDuplicates(["doc_id", "__text_hash"])
    return _unwrapped(one.unionByName(marked.where("doc_id is null")), docs)


def _whole_characters(text: Column) -> Column:
    """`text` without bytes that form no character.  Replacement characters of its own are kept: they are escaped while
    those that stand for such bytes are taken out."""
    own, mark, one, two = (F.lit(x) for x in ("\ufffd", "\x01", "\x01\x02", "\x01\x03"))
    valid = F.replace(F.make_valid_utf8(F.replace(F.replace(text, mark, one), own, two)), own, F.lit(""))
    return F.replace(F.replace(valid, two, own), one, mark)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by strings that start elsewhere too are cut out; what an edge leaves of a character goes as well."""
    kept = suffix_dedup.remove_repeats(_wrapped(docs))
    text = F.col("kept").cast("string")
    return _unwrapped(kept.withColumn("text", F.when(F.col("n_removed") > 0, _whole_characters(text)).otherwise(text)), docs, True)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret is replaced by a mark."""
    return _unwrapped(secrets.find_secrets(_wrapped(docs)).withColumnRenamed("redacted", "text"), docs, True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and place."""
    return packing.pack_documents(docs, added=public_tokenizers.path(packing.ADDED)).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", drop_repeats),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again for the next."""
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), mark)  # what the stage and those before it have kept goes
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokens, fingerprints and scores have no SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None
