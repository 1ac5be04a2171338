"""A cleaning pipeline over documents: each stage works on all rows that the one before kept.

Stages: toxicity (rejected documents go), line dedup (repeated lines go; a document that loses all its lines goes),
SimHash near-dedup (one document of each group stays), benchmark decontamination (documents that hold a window of a
benchmark item go), byte-level BPE (ids and decoded text's digests). Each stage's rows are written as Parquet to the
shared folder and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fordway.llm import byte_bpe, decontaminate, line_dedup, simhash, toxicity
from fordway.llm.common import Workspace, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_ordinary(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand elsewhere; documents without any line before stay, those left with none go."""
    n_lines, n_kept = (f"_{k}_" + "_".join(docs.columns) for k in ("lines", "kept"))
    found = line_dedup.dedup_lines(docs).toDF(*docs.columns, n_lines, n_kept)
    stay = found.where((F.col(n_lines) == 0) | (F.col(n_kept) > 0))
    if "n_chars" in docs.columns:
        stay = stay.withColumn("n_chars", F.when(F.col(n_lines) == F.col(n_kept), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return stay.select(*docs.columns)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return byte_bpe.encode_decode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_near),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = ws.store(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            ws.drop(f"stage-{k - 1}")
    return docs


#: Scores and similarities of the stages are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None
