"""The registered queries of this package: thin digests of the operators' results."""

from __future__ import annotations

import public_tokenizers as tokenizer_files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_tree, containment, cross_entropy, fill_middle, licences, line_rules, orc_tokens, pii, piece_bpe, segment_join, token_align, token_counts, toxicity
from .common import load

WORD_VOCAB, BYTE_VOCAB, PIECE_MODEL = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(load(spark, sf_dir, "documents"), tokenizer_files.path(WORD_VOCAB))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = line_rules.apply_rules(load(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return ruled.select("doc_id", *line_rules.STATS, "base_failed", "n_removed_lines", "n_left_words", "kept")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_join.join_groups(load(spark, sf_dir, "documents"))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = tokenizer_files.path(BYTE_VOCAB)
    return bpe_tree.digests(bpe_tree.decode_documents(bpe_tree.encode_documents(load(spark, sf_dir, "documents"), vocab), vocab))


def op6_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orc_tokens.round_trip(load(spark, sf_dir, "documents"), tokenizer_files.path(WORD_VOCAB))


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(load(spark, sf_dir, "documents"))


def op8_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_entropy.score(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(load(spark, sf_dir, "documents")))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.restore_documents(fill_middle.transform_documents(load(spark, sf_dir, "documents"))))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_files.path(PIECE_MODEL)
    return piece_bpe.digests(piece_bpe.decode_documents(piece_bpe.encode_documents(load(spark, sf_dir, "documents"), model), model))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab, model = tokenizer_files.path(BYTE_VOCAB), tokenizer_files.path(PIECE_MODEL)
    return token_align.digests(token_align.align_documents(load(spark, sf_dir, "documents"), vocab, model, hashed=True))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_quality_rules, op3_toxicity, op4_ngram_join, op5_bpe_round_trip, op6_orc_tokens, op7_licence_scan, op8_cross_entropy, op9_decontamination, op10_personal_data, op11_fill_in_middle, op12_sentencepiece, op13_token_alignment)}
ORACLE = {"op2_quality_rules": line_rules.SQL, "op4_ngram_join": segment_join.SQL, "op9_decontamination": containment.SQL}
