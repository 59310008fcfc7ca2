"""Corpus preparation: five stages over ``documents``, each written and read again.

1. language ID: documents without letters and those whose language stays
   doubtful (score under ``LEAST_SCORE``) go;
2. MinHash near-dedup (five-word shingles, similarity 0.8): one document of
   each group stays;
3. suffix-array dedup: bytes of repeated 100-byte strings go, all but the first
   occurrence; a text left without a word goes;
4. benchmark decontamination: documents with a benchmark passage go;
5. best-fit packing into sequences of 1024 tokens.

All but the last return the columns of their input.  Rows that share an id and
a text are one document; null ids stay null.  Null texts are rejected by stage 1;
an empty table stays empty.  Very long texts are held whole by a task in stages 2
to 4 (see the operators).  Extra columns, whatever their names, pass through the
first four stages.  What operators write on the way is deleted after each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontam, langid, minhash, packing, suffix_dedup
from ledgerloom.llm.common import Workspace, unused
from ledgerloom.sources.workspace import dropped_after

LEAST_SCORE = 0.3


def _kept(docs: DataFrame, out: DataFrame) -> DataFrame:
    return out.select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs)
    return _kept(docs, langid.keep(docs, model, LEAST_SCORE))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(docs)
    # documents without words link with nothing and stay
    (own,) = unused(docs, "_id")
    stay = found.where("kept").select(F.col("doc_id").alias(own)).distinct()
    return _kept(docs, docs.join(stay, docs["doc_id"].eqNullSafe(stay[own]), "left_semi"))


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = suffix_dedup.clean(docs)
    out = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned
    return _kept(docs, out.where(F.col("text").rlike("[^\\x20\\x09-\\x0D]")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    # ids and digests of contaminated documents only, far fewer than documents
    own, digest = unused(docs, "_id", "_digest")
    bad = found.select(F.col("doc_id").alias(own), F.col("digest").alias(digest)).distinct()
    same = docs["doc_id"].eqNullSafe(bad[own]) & (F.crc32(F.coalesce(docs["text"], F.lit(""))) == bad[digest])
    return _kept(docs, docs.join(bad, same, "left_anti"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", language),
    ("minhash", near_dedup),
    ("suffix_array", substring),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Not expressible in SQL: trained models and tokenizers; tested against brute force, stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = ""
    for name, stage in STAGES:
        with dropped_after():
            docs = work.save(stage(spark, docs, sf_dir), name)
        if before:
            work.drop(before)  # the next stage has been written
        before = name
    return docs
