"""Corpus pipeline: from raw documents to token ids, in five stages.

Each stage is a function of (spark, docs, sf_dir) that returns a table; ``run`` writes it as
Parquet in the shared folder and reads it again as the next stage's ``docs``. All
stages but the last return the columns of ``documents``.

1. toxicity          documents that the ordinal model rejects go
2. line_dedup        lines that repeat an earlier line, or nearly, go; so do documents left without a word or
                     with nothing but short lines that earlier documents hold, too
3. near_duplicates   of each component of similar documents the one with the smallest id stays
4. decontamination   documents that hold a benchmark window go
5. byte_bpe          byte-level BPE ids, with the digest of what they decode to

Rows with a null id can't be told apart by the stages that refer to documents by id (3 and 4): they
pass these unchanged. Rows that repeat id and text are one document: stage 3 keeps one. Further
columns of the input are dropped. An empty table passes as an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrain.llm import byte_bpe, decontaminate, line_dedup, ngram_jaccard, toxicity
from casegrain.llm.tables import free, membership_bits, read, with_membership, without, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# No SQL expresses the fitted model, the tokenizer or the join at these sizes; the tests hold a brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(COLUMNS)
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, COLUMNS).where("NOT rejected").select(COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(COLUMNS)
    kept = line_dedup.without_leftovers(line_dedup.deduplicate(docs), docs)
    changed = F.size("dropped") > 0
    return kept.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
                           ).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(COLUMNS)
    found = written(ngram_jaccard.join(docs), "near-duplicates")     # ids only
    left = without(docs, found.where("component_id <> doc_id").select("doc_id").distinct())
    # Ids on several rows are rare: only those rows are compared.
    several = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    told = with_membership(left.withColumn("h", F.xxhash64("doc_id")), "h",
                           membership_bits(several.select(F.xxhash64("doc_id").alias("h")), "h"), "maybe")
    return told.where("NOT maybe").select(COLUMNS).unionByName(
        told.where("maybe").select(COLUMNS).dropDuplicates(["doc_id", "text"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(COLUMNS)
    found = decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))
    return without(docs, found.where("size(spans) > 0 AND doc_id IS NOT NULL").select("doc_id").distinct())


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = byte_bpe.encode(docs.select(COLUMNS), path, public_tokenizers.PATTERN, ["doc_id", "lang", "source"])
    back = byte_bpe.decode(ids, path, ["doc_id", "lang", "source", "ids"])
    return back.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                       F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = read(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        now: list[DataFrame] = []
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}", scratch=now)
        free(last)      # a stage's documents go when the next stage's are complete
        last = now
    return STAGES[-1][1](spark, docs, sf_dir)
