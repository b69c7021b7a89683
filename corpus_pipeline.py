"""A training corpus from raw documents: language, lines, near-duplicates, benchmark leaks, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame with the columns of
documents (the last: packed pieces). run() writes each stage's rows as Parquet and reads them for the next.

Stages that drop documents judge rows, not doc_ids: each row gets a key, written with the stage's input, and is dropped by it
alone. So of rows that share a doc_id, or have none, only those that are copies or hold a benchmark item go; repeated rows are
copies of one another, and one of them stays. Null and empty texts have no language and go with the first stage; the later
stages keep them, each as it is. Very long texts are read whole. An empty table gives an empty result of every stage. Other
columns pass through all stages but the last, whatever their names: names of the stages' own columns give way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vane.llm.decontam import find_contamination
from vane.llm.langid import held_out, identify
from vane.llm.line_dedup import drop_frequent_lines
from vane.llm.near_dup import near_duplicates
from vane.llm.packing import pack_documents
from vane.llm.text_batches import free_name
from vane.plans.shared import stored


#: Ids up to this many (8 bytes each) go to all executors; more are joined by shuffle.
MAX_BROADCAST_IDS = 1_000_000


def with_row_keys(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key that is written once and so the same in every read, and the key's name."""
    key = free_name(docs.columns, "row_key")
    return stored(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def without(keyed: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    """keyed, without the key, but for the rows whose key is in rows."""
    gone = F.broadcast(rows) if rows.count() <= MAX_BROADCAST_IDS else rows.hint("merge")
    return keyed.join(gone, key, "left_anti").drop(key)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model accepts. It is trained on the rows that op2 may learn from; of rows that repeat, each is judged alike."""
    answers = tuple(free_name(docs.columns, c) for c in ("lang_pred", "score", "rejected"))
    train = docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    found = identify(docs, train, carried=docs.columns, answers=answers)
    return found.where(~F.col(answers[2])).select(*docs.columns)


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten of them hold; n_chars, where there is one, follows the text."""
    key = free_name(docs.columns, "row_key")
    own = docs.toDF(*[c if c in ("doc_id", "text") else f"c{i}_" for i, c in enumerate(docs.columns)])  # no name of the operator's among them
    clean = drop_frequent_lines(own).withColumn(key, F.col("n_dropped") > 0)
    now = {"text": F.when(F.col(key), F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        at = docs.columns.index("n_chars")
        now["n_chars"] = F.when(F.col(key), F.length("kept_text")).otherwise(F.col(own.columns[at])).cast(docs.schema["n_chars"].dataType)
    return clean.select(*[now.get(c, F.col(o)).alias(c) for c, o in zip(docs.columns, own.columns)])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group (five words, similarity 0.8): that with the smallest doc_id, without one only if no other has one; of ties the first key."""
    keyed, key = with_row_keys(docs)
    found = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), similarity=0.8, width=5)
    found = stored(found.select(F.col("doc_id").alias(key), "component_id"), "groups")
    named = found.join(keyed.select(key, "doc_id"), key)
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", key)).alias("first"))
    return without(keyed, key, stored(found.join(first.select(f"first.{key}"), key, "left_anti").select(key), "copies"))


def unseen_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    keyed, key = with_row_keys(docs)
    leaks = find_contamination(keyed.select(F.col(key).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(keyed, key, stored(leaks.select(F.col("doc_id").alias(key)).distinct(), "leaks"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and the sequences that they fill, of every row."""
    return pack_documents(docs)


STAGES = [("language", known_language), ("line_dedup", unrepeated_lines), ("near_dup", one_of_each_group), ("decontamination", unseen_benchmark), ("packing", packed_sequences)]

#: Learned and iterative stages have no SQL; a test holds each stage's rows against a plain version of it, and small cases cover odd rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
