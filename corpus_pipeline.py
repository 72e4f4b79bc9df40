"""A corpus pipeline of five stages, each one operator of tessera.llm.

Each stage takes (spark, docs, sf_dir), works on every document its
predecessor kept, and returns a DataFrame; `run` writes it as Parquet to the
shared folder and reads it back as the next stage's documents. All stages but
the last return the columns of documents. Extra columns of the input are
dropped, as the stages name theirs."""

from __future__ import annotations

import public_tokenizers as tokenizer_files
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe_tree, containment, line_rules, pii, segment_join
from tessera.llm.common import load, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
VOCAB = "byte_bpe_50k.json"


def _with_text(df: DataFrame, text: str) -> DataFrame:
    """The document columns with another text and its length; unchanged texts keep their n_chars."""
    same = F.col(text).eqNullSafe(F.col("text"))
    n = F.when(same, F.col("n_chars")).otherwise(F.length(text).cast("long"))
    return df.select("doc_id", F.col(text).alias("text"), "lang", "source", n.alias("n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines above their host's limit leave the others."""
    ruled = line_rules.apply_rules(docs.select(*COLUMNS)).select("doc_id", "clean_text", "lang", "source", "n_chars", "n_removed_lines", "kept")
    # Written before it is filtered, or the optimizer copies the rules' expressions into the filter.
    done = stored(ruled, "ruled").where("kept")
    n = F.when(F.col("n_removed_lines") == 0, F.col("n_chars")).otherwise(F.length("clean_text").cast("long"))
    return done.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", n.alias("n_chars"))


def _row_key() -> Column:
    """16 bytes that tell rows apart by all columns."""
    part = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.unhex(F.substring(F.sha2(F.concat(*map(part, COLUMNS)), 256), 1, 32))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the first by id (null ids last), then by a
    hash of all columns. Rows are told apart by all columns, so neither a null id nor
    one that stands with several texts matters. Rows without words are in no group and stay."""
    named = docs.select(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", _row_key().alias("key")).alias("row"), *COLUMNS)
    groups = stored(segment_join.join_groups(named, id_col="row"), "near_duplicates")
    first = groups.where((F.col("row") == F.col("component_id")) | (F.col("n_shingles") == 0)).select(F.col("row.key").alias("key"), (F.col("n_shingles") > 0).alias("linked")).distinct()
    kept = named.withColumn("key", F.col("row.key")).join(first, "key")
    # Exact repeats of a row share its key: one stays, but all of a row without words.
    one = kept.where("linked").dropDuplicates(["key"])
    return one.unionByName(kept.where("NOT linked")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Rows are told apart by all
    columns: one without an id can go, and of an id with several texts only those that leak."""
    named = docs.select(*COLUMNS, _row_key().alias("key"))
    hit = containment.leaks(named, load(spark, sf_dir, "benchmark"), id_col="key").select("key").distinct()
    return named.join(hit, "key", "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found is replaced by its kind."""
    found = pii.find(docs.select(*COLUMNS).withColumn("row", F.struct(*COLUMNS)), "row", with_text=True)
    return _with_text(found.select("row.*", "clean_text"), "clean_text")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256)."""
    vocab = tokenizer_files.path(VOCAB)
    # Written between: chained, each task would hold two Python workers at once.
    encoded = stored(bpe_tree.encode_documents(docs, vocab), "encoded")
    decoded = bpe_tree.decode_documents(encoded, vocab)
    return bpe_tree.digests(decoded)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("encoding", encoding)]

#: Encoding and span detection have no SQL; a test compares near_duplicates with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
