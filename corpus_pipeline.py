"""A corpus pipeline of five operators; each stage gets what its predecessor kept, written as Parquet and read again."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import materialize, table
from rowloom.llm.decontamination import contamination
from rowloom.llm.line_dedup import dedup_lines
from rowloom.llm.near_dedup import near_duplicates
from rowloom.llm.packing import pack_documents
from rowloom.llm.quality import scored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    return scored(docs, table(spark, sf_dir, "labels")).filter("predicted = 1").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many share but for their last holder; n_chars counts the text that is left."""
    left = dedup_lines(docs.select(*COLUMNS))
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with a key of their own, written once: ids can be null or repeated."""
    return materialize(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates, that with the least id; rows without an id come last."""
    docs = keyed(docs)
    classes = near_duplicates(docs, id_col="row").select(F.col("doc_id").alias("row"), F.col("class_id").alias("class"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row"))
    kept = docs.select("row", "doc_id").join(classes, "row").groupBy("class").agg(first["row"].alias("row")).select("row")
    return docs.join(kept, "row", "left_semi").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any benchmark passage, each judged by its text."""
    docs = keyed(docs)
    named = contamination(docs, table(spark, sf_dir, "benchmark"), id_col="row").filter("contaminated").select(F.col("doc_id").alias("row"))
    return docs.join(named, "row", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces of all documents in sequences of at most 4096 tokens."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The classifier's fit, sampled signatures and the tokenizer have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
