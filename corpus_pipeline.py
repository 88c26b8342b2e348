"""A training corpus from documents: stages that each take all that the one before kept.

STAGES: (name, function of (spark, docs, sf_dir)); each result is written as Parquet and read again as the next stage's docs. All but the
last return the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import jaccard, packing, pii, quality, windows
from pointloom.llm.shared import stored


def _with_text(docs: DataFrame, text) -> DataFrame:
    """docs with another text, and n_chars as long as it where that is a column."""
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return jaccard.representatives(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document of smaller doc_id has go."""
    return _with_text(windows.clean_documents(docs), F.col("text"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets."""
    kept = docs.select("text", F.struct(*docs.columns).alias("row"))
    found = pii.find(kept)
    text = F.when(F.size("spans") > 0, pii.redacted("text", "spans")).otherwise(F.col("row.text"))
    return _with_text(found.select(*((text if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns)), F.col("text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of permitted lengths."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", one_of_each_group),
    ("substring dedup", drop_repeats),
    ("PII", redact),
    ("best-fit packing", pack),
]

#: The classifier can't be put in SQL; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
