"""The registered queries of this subpackage: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers

from evalloom.llm import bpe, chat_format, language_id, near_texts, near_vectors, ngram_score, packing, periodic_runs, quality_classifier, quality_rules, repeated_spans, token_alignment, token_binary
from evalloom.llm.common import documents

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"


def op1_quality_classifier(spark, sf_dir):
    return quality_classifier.query(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op2_quality_rules(spark, sf_dir):
    return quality_rules.query(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op3_near_vectors(spark, sf_dir):
    return near_vectors.near_duplicates(documents(spark, sf_dir, "embeddings"))


def op4_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE))


def op5_chat_format(spark, sf_dir):
    return chat_format.query(documents(spark, sf_dir, "conversations"))


def op6_bpe(spark, sf_dir):
    return bpe.query(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE))


def op7_ngram_score(spark, sf_dir):
    return ngram_score.query(documents(spark, sf_dir))


def op8_language_id(spark, sf_dir):
    return language_id.query(documents(spark, sf_dir))


def op9_near_texts(spark, sf_dir):
    return near_texts.near_duplicates(documents(spark, sf_dir))


def op10_token_binary(spark, sf_dir):
    return token_binary.query(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE))


def op11_token_alignment(spark, sf_dir):
    return token_alignment.query(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE))


def op12_repeated_spans(spark, sf_dir):
    return repeated_spans.query(documents(spark, sf_dir))


def op13_periodic_runs(spark, sf_dir):
    return periodic_runs.query(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_quality_rules, op3_near_vectors, op4_packing, op5_chat_format, op6_bpe, op7_ngram_score, op8_language_id, op9_near_texts, op10_token_binary, op11_token_alignment, op12_repeated_spans, op13_periodic_runs)}

ORACLE_SQL = {"op2_quality_rules": quality_rules.oracle_sql(), "op5_chat_format": chat_format.oracle_sql()}
