"""From raw documents to training tokens: toxicity, line dedup, near-duplicate groups, decontamination, BPE encoding.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written and read again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontaminate, line_dedup, ngram_join, toxicity
from millrace.llm.common import fresh, read_table, release_table, set_aside, spread, written
from millrace.llm.queries import tokenizer_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("unwanted"), "toxic")
    chain = toxicity.train(docs, labels, ("unwanted", "toxic"))
    plain, back = set_aside(docs, "p_unwanted", "p_toxic")
    return back(toxicity.score(plain, chain).where(F.col("p_toxic") < toxicity.REJECT_FROM))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go, everywhere; a document without lines left stays, with an empty text."""
    plain, back = set_aside(docs, "n_lines", "n_dropped", "kept_sha256")
    out = back(line_dedup.dedup_lines(plain))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays (five words, similarity of 0.8), the one with the smallest id, null ids
    last; of rows with one id the first one written. Rows are told apart by a written key, so ids may repeat or be null."""
    row = fresh(docs, "row_key")
    keyed = written(docs.withColumn(row, F.monotonically_increasing_id()))
    # The order of the keys is the order of choice.
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(row).alias("row"))
    found = ngram_join.jaccard_components(keyed.select(key.alias("key"), "text"), id_col="key", shingle=5, percent=80)
    gone = found.where("component_id.row <> id.row").select(F.col("id.row").alias(row))
    return keyed.join(gone, row, "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with enough words inside benchmark passages go."""
    plain, back = set_aside(docs, "n_words", "n_hit", "hit_spans", "item_ids")
    found = decontaminate.find_benchmark_windows(plain, read_table(spark, sf_dir, "benchmark"))
    return back(found.where(~decontaminate.contaminated()))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, their number and hash, and the hash of the text that they decode to."""
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), tokenizer_path(), decode=True)
    return encoded.select(
        "doc_id", "lang", "source", "n_tokens", "input_ids", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("n-gram jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("bpe encoding", encoding_stage),
]

#: The chain, the perfect hash and the signatures can't be written in SQL; tests compare run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents"))
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
            if k:
                release_table(before)
    return docs
