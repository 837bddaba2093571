"""From raw documents to pieces: toxic documents go, frequent lines go, one of each group of near copies stays, documents that hold
benchmark passages go, and what remains is encoded.

Each stage takes the whole result of the one before it, written as Parquet. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm.decontaminate import PASSAGE, decontaminate
from tallyflow.llm.line_dedup import line_dedup
from tallyflow.llm.minhash_dedup import near_duplicates
from tallyflow.llm.rendezvous import shared_folder
from tallyflow.llm.sentence_pieces import decode, encode
from tallyflow.llm.toxicity import fit, score_toxicity

#: Documents with a score from here on go.
TOXIC_FROM = 0.5
#: Percent of the union of five-word shingles that near copies share.
NEAR_PERCENT = 80
PIECE_MODEL = "piece_bpe_32k.model"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity, learned from the labels, is below the limit."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(docs, model, score="_toxicity", hits="_toxic_hits")
    return scored.where(F.col("_toxicity") < TOXIC_FROM).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the frequent lines that a later document holds."""
    return line_dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies, and all others."""
    copies = near_duplicates(docs, percent=NEAR_PERCENT).where("NOT kept").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), passage=PASSAGE).select(*docs.columns)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its piece ids; the text is what these decode to."""
    import public_tokenizers

    path = public_tokenizers.path(PIECE_MODEL)
    return decode(encode(docs, path), path, text_col="text").select(*docs.columns, "piece_ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentence pieces", to_pieces),
]

#: Learned scores, components and Viterbi paths have no SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``. What a stage returns is written to the shared folder and goes when the next one is there."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(path := f"{folder}/{k}")
        if before:
            _delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
