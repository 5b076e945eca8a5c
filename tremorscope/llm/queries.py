"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from . import compression_lang, impact_search, line_dedup, ngram_trie, order_minhash, packing, passage_dedup, phrase_mining, secret_scan, simhash, source_mixing, token_alignment, url_reputation


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_impact_search(spark, sf_dir):
    return impact_search.digest(_table(spark, sf_dir, "embeddings"))


def op2_simhash(spark, sf_dir):
    return simhash.digest(_table(spark, sf_dir, "documents"))


def op3_ngram_trie(spark, sf_dir):
    return ngram_trie.digest(_table(spark, sf_dir, "documents"))


def op4_packing(spark, sf_dir):
    return packing.digest(_table(spark, sf_dir, "documents"))


def op5_order_minhash(spark, sf_dir):
    return order_minhash.digest(_table(spark, sf_dir, "documents"))


def op6_source_mixing(spark, sf_dir):
    return source_mixing.digest(_table(spark, sf_dir, "documents"))


def op7_language_id(spark, sf_dir):
    return compression_lang.digest(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark, sf_dir):
    return line_dedup.digest(_table(spark, sf_dir, "documents"))


def op9_url_filter(spark, sf_dir):
    return url_reputation.digest(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op10_passage_dedup(spark, sf_dir):
    return passage_dedup.digest(_table(spark, sf_dir, "documents"))


def op11_phrase_mining(spark, sf_dir):
    return phrase_mining.digest(_table(spark, sf_dir, "documents"))


def op12_secret_scan(spark, sf_dir):
    return secret_scan.digest(_table(spark, sf_dir, "documents"))


def op13_token_alignment(spark, sf_dir):
    return token_alignment.digest(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_impact_search, op2_simhash, op3_ngram_trie, op4_packing, op5_order_minhash, op6_source_mixing, op7_language_id, op8_line_dedup, op9_url_filter, op10_passage_dedup, op11_phrase_mining, op12_secret_scan, op13_token_alignment)}
ORACLES = {"op1_impact_search": impact_search.ORACLE, "op11_phrase_mining": phrase_mining.ORACLE, "op6_source_mixing": source_mixing.ORACLE, "op8_line_dedup": line_dedup.ORACLE, "op9_url_filter": url_reputation.ORACLE}
