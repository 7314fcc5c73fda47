"""A corpus pipeline: toxicity, near duplicates, personal data, packing.

STAGES are (name, function of (spark, docs, sf_dir)); each gets what its predecessor kept, written as Parquet and read again.
All but the last return the columns of documents. SQL cannot express the first, third and last stage; tests hold each against a
brute-force version.

Nulls and repeated rows are as the operators define them: a null text is clean, has no duplicates and one token; of a group of near duplicates
the row with the smallest doc_id stays (null ones last; rows that share it go by their place in the input).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import jaccard_join, packing, pii, toxicity
from chronofold.llm._common import discard, materialize


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, fitted on the labelled documents of sf_dir, doesn't call toxic."""
    return toxicity.drop_toxic(docs, toxicity.fit_on_tables(spark, sf_dir))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates.

    Rows are numbered once and written, so that the choice is the same in every attempt of a task.
    """
    numbered = materialize(docs.select(F.monotonically_increasing_id().alias("__row"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]), "pipeline-numbered")
    names = {c.lower(): f"c{k}" for k, c in enumerate(docs.columns)}
    # The row's number stands in for doc_id, so that every row is a document of its own.
    found = jaccard_join.link_components(numbered.select(F.col("__row").alias("doc_id"), F.col(names["text"]).alias("text"))).select(F.col("doc_id").alias("__row"), "label")
    rank = F.struct(F.col("id").isNull().alias("last"), F.coalesce("id", F.lit(0)).alias("id"), F.col("__row").alias("row"))
    best = found.join(numbered.select("__row", F.col(names["doc_id"]).cast("long").alias("id")), "__row").groupBy("label").agg(F.min(rank).alias("best")).select(F.col("best.row").alias("__row"))
    kept = numbered.join(best, "__row", "left_semi").coalesce(max(spark.sparkContext.defaultParallelism, len(numbered.inputFiles())))
    return kept.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, each span of personal data replaced by its kind; n_chars follows the text where the column is there."""
    done = pii.redact(docs)
    text = next(c for c in done.columns if c.lower() == "text")
    size = [c for c in done.columns if c.lower() == "n_chars"]
    kinds = dict(done.dtypes)
    return done.withColumns({c: F.when(F.col(text).isNull(), F.col(c)).otherwise(F.char_length(text)).cast(kinds[c]) for c in size})


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document, with its sequence and place."""
    import public_tokenizers

    return packing.pack(packing.cut_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("personal_data", without_personal_data),
    ("packing", packed_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
