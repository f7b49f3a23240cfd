"""The corpus pipeline: from documents to packed sequences in five stages, each written as Parquet and reread by the next.

Every stage works on all rows that its predecessor kept. Rows whose id is null pass the stages that link or count by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.jaccard_join import Similarity, jaccard_components
from strandline.llm.language_id import fit_language_models, keep_identified, training_rows
from strandline.llm.line_dedup import dedup_passages
from strandline.llm.mixing import mix
from strandline.llm.packing import pack_documents
from strandline.llm.queries import _tokenizer
from strandline.llm.shared import small_batches, stage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the models of the known languages don't reject: null texts and those without letters go, rows with null ids or languages are judged by their text."""
    small_batches(spark)
    return keep_identified(docs, fit_language_models(training_rows(docs)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages met before; a document of which nothing is left goes, one that was empty or null before stays. Null ids come last; rows that repeat id and text share their fate."""
    done = dedup_passages(docs)
    left = done.where((F.col("n_removed") == 0) | (F.length("text") > 0))
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("row.n_chars"))}
    return left.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8), that with the smallest id. Rows with a null id or without words stay, and so do rows that repeat the kept id."""
    small_batches(spark)
    found = jaccard_components(docs, Similarity(words=5, below=80, above=100))
    copies = found.where("doc_id <> component_id").select(F.col("doc_id").alias("copy_id")).distinct()
    return docs.join(copies, docs["doc_id"] == copies["copy_id"], "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows that repeat id and text get the fewest copies of theirs. Null and empty texts are kept once, and a null source is a source of its own."""
    key = F.xxhash64("doc_id", "text")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("_id"), key.alias("_key"))
    taken = mix(docs, row_hash=True).groupBy(F.col("doc_id").alias("t_id"), F.col("row_hash").alias("t_key")).agg(F.min("copies").alias("copies"))
    both = keyed.join(taken.where("copies > 0"), F.col("_id").eqNullSafe(F.col("t_id")) & (F.col("_key") == F.col("t_key")))
    return both.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens. Null ids and texts are packed too (a null text as the stop id); an empty table gives none.

    Executors are still full of the stages before, so workers keep fewer words than they would alone.
    """
    small_batches(spark)
    return pack_documents(docs, _tokenizer(), known_words=100_000, slice_bytes=1 << 19)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join), ("mixing", mixing), ("packing", packing)]

#: The models, the tilted rates and the vocabulary can't be expressed in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
