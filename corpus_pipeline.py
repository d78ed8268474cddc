"""From raw documents to token ids: five stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from leadloom.llm.common import Stage, broadcast_small
from leadloom.llm.op1_templates import decontaminate
from leadloom.llm.op3_kneser_ney import identify
from leadloom.llm.op4_piece_lattice import default_model, encode
from leadloom.llm.op5_line_runs import dedup_lines
from leadloom.llm.op8_superminhash import near_duplicates
from leadloom.session import configure

#: Dropped ids are broadcast up to so many (8 bytes each), else joined by a shuffle.
BROADCAST_IDS = 4_000_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language; texts that are null, without letters or rejected go."""
    configure(spark)
    return identify(docs).where("not rejected").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many share; text and n_chars follow.  Null texts stay null."""
    configure(spark)
    out = dedup_lines(docs)
    changed = F.col("n_dropped") > 0
    columns = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(changed, F.length("kept_text").cast(docs.schema["n_chars"].dataType)) \
            .otherwise(F.col("n_chars"))
    return out.withColumns(columns).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest doc_id.

    Documents without words and rows without a doc_id stay.  Of rows that
    repeat a doc_id one stays, with the smallest text.
    """
    configure(spark)
    stage = Stage(spark, "kept")
    groups = near_duplicates(docs.select("doc_id", "text"), bands=48)
    gone = stage.put(groups.where("not kept").select("doc_id"), "gone")
    rest = docs.join(broadcast_small(gone, BROADCAST_IDS), "doc_id", "left_anti").select(*docs.columns)
    repeated = stage.put(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and doc_id is not null")
                         .select("doc_id"), "repeated")
    if not repeated.limit(1).count():
        return rest
    ids = broadcast_small(repeated, BROADCAST_IDS)
    whole = F.struct(*[F.col(c) for c in ["text", *[c for c in docs.columns if c not in ("doc_id", "text")]]])
    once = (rest.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(whole).alias("row"))
            .select("doc_id", "row.*").select(*docs.columns))
    return rest.join(ids, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    configure(spark)
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    configure(spark)
    model = default_model(spark)
    out = encode(docs.select("doc_id", "lang", "source", "text"), model, verify=True)
    return out.select("doc_id", "lang", "source", "ids", F.size("ids").alias("n_pieces"), "round_trip")


STAGES = [("language", language), ("lines", lines), ("near", near), ("clean", clean), ("pieces", pieces)]

#: Language models and piece folds have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and reread."""
    configure(spark)
    stage = Stage(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage.put(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
