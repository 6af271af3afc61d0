"""From raw documents to a training mix.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents; further columns pass through.

1. quality: documents that the quality classifier scores below 0.5 go.
2. lines: repeated runs of lines go, a line of 32 bytes or more being a run by itself, and n_chars follows; documents of which nothing but blanks is left go.
3. near copies: of each component of the Jaccard join the document with the least doc_id stays.
4. benchmark: documents with a passage that aligns with a test item go.
5. mix: each document comes as often as the mix takes it, with its number as copy.

Tables may be empty, texts null, empty or very long, and rows repeated; the operators say what then holds. The classifier can't
be expressed in SQL, so that there is none for the whole; tests hold each stage against a plain version of its rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import contamination, jaccard, lines, mixing, quality
from stratalog.llm.shared import bounded, new_folder, scratch

#: Needs a trained classifier.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return quality.good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = docs.columns
    # the row travels as one column, whatever its names
    kept = lines.with_kept_lines(docs.select("doc_id", "text", F.struct(*names).alias("_row")), ["_row"])
    kept = kept.where((F.col("n_removed") == 0) | (F.trim("kept", F.lit(lines.BLANKS + "\n")) != ""))
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col("_row.text")), "n_chars": F.when(changed, F.char_length("kept").cast("long")).otherwise(F.col("_row.n_chars"))}
    return kept.select(*(new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in names))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return jaccard.one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return contamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.copies_of(docs)


STAGES = [("quality", quality_stage), ("lines", lines_stage), ("near_copies", near_copies_stage), ("benchmark", benchmark_stage), ("mix", mix_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        at = new_folder(spark, f"pipeline-{name}")
        with scratch():  # what a stage wrote on its way
            out = stage(spark, docs, sf_dir)
            out.write.parquet(at)
        docs = spark.read.schema(out.schema).parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
