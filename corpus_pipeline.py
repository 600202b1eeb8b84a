"""A corpus pipeline: language identification, exact, near and passage deduplication, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.  A stage works on all that
the one before it kept, and is written and read again between the two.

Defined results.  A null or empty text has no letter and goes in the first stage.  Rows are told apart by a key of their own, whatever their doc_ids: of rows
that repeat a text, or that share or lack a doc_id, exactly one of each group of copies stays.  Ties of equal or near texts go to the smaller
doc_id, null last.  Texts of any length are read whole.  Extra columns, whatever their names, come through all stages but the last.  An
empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import fresh_path, table
from sightline.llm.exact_dedup import exact_dedup
from sightline.llm.language_id import keep_identified
from sightline.llm.near_texts import near_texts
from sightline.llm.packing import pack_documents
from sightline.llm.suffix_dedup import removed_spans


def _free(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _numbered(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number, and that column's name: distinct for each row and in the order of doc_id, null last, and doc_id itself where that is distinct.

    Rows that share a doc_id are in the order of a hash of the text; the rows are then written, so that their numbers stay."""
    key, name = F.col("doc_id").cast("long"), _free(docs, "row")
    if not docs.groupBy(key.alias("id")).count().filter(F.col("id").isNull() | (F.col("count") > 1)).limit(1).count():
        return docs.withColumn(name, key), name
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [key.asc_nulls_last(), F.xxhash64("text")]
    path = fresh_path(spark, "pipeline-rows")
    docs.repartitionByRange(n, *order).sortWithinPartitions(*order, "text").withColumn(name, F.monotonically_increasing_id()).write.parquet(path)
    return spark.read.parquet(path), name


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; those without a letter, or that no language explains, go.

    Where no language is taught, all that have a letter stay."""
    return keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, whatever their doc_ids."""
    rows, row = _numbered(spark, docs)
    kept = exact_dedup(rows.select(F.col(row).alias("doc_id"), "text")).filter("kept").select(F.col("doc_id").alias(row))
    return rows.join(kept, row, "left_semi").select(*_columns(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each component of texts whose five-word shingles have a similarity of 0.8 or more.  A text
    without words has no near copy."""
    rows, row = _numbered(spark, docs)
    found = near_texts(rows.select(F.col(row).alias("row"), "text"))
    copies = found.filter("node <> root").select(F.col("node").alias(row))
    return rows.join(copies, row, "left_anti").select(*_columns(docs))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a row before it in the order of doc_id holds; documents of which nothing is left go."""
    rows, row = _numbered(spark, docs)
    own = _free(rows, "id")
    rows = rows.withColumnRenamed("doc_id", own).withColumnRenamed(row, "doc_id")
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cut = removed_spans(rows, carry=[own, *rest], keep_bytes=True, whole_points=True)
    text = F.col("kept").cast("string")
    values = {"doc_id": F.col(f"rest.`{own}`"), "text": text, "n_chars": F.length(text).cast("long")} | {c: F.col(f"rest.`{c}`") for c in rest}
    return cut.filter((F.col("n_removed") == 0) | (F.octet_length("kept") > 0)).select(*[values[c].alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("passages", passages), ("packing", packing)]

#: Fingerprints, suffix sorting and tokenisation are no SQL: tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet in the shared folder and read again; what a stage has read is removed once the stage is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            folder = spark._jvm.org.apache.hadoop.fs.Path(before)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
