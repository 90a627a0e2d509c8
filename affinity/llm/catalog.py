"""Queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, decontaminate, embedding_dedup, jaccard, langid, licences, phrases, quality, runs, sentences, shard, suffix_dedup, toxicity

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_ngram_jaccard_join": jaccard.op2_ngram_jaccard_join,
    "op3_bpe_encoding": bpe.op3_bpe_encoding,
    "op4_substring_dedup": sentences.op4_substring_dedup,
    "op5_benchmark_decontamination": decontaminate.op5_benchmark_decontamination,
    "op6_sharding": shard.op6_sharding,
    "op7_embedding_near_dedup": embedding_dedup.op7_embedding_near_dedup,
    "op8_license_scans": licences.op8_license_scans,
    "op9_suffix_array_dedup": suffix_dedup.op9_suffix_array_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_quality_classifier": quality.op11_quality_classifier,
    "op12_periodic_runs": runs.op12_periodic_runs,
    "op13_phrase_collocations": phrases.op13_phrase_collocations,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op2_ngram_jaccard_join": jaccard.SQL,
    "op4_substring_dedup": sentences.SQL,
    "op6_sharding": shard.SQL,
    "op7_embedding_near_dedup": embedding_dedup.SQL,
    "op8_license_scans": licences.SQL,
    "op9_suffix_array_dedup": suffix_dedup.SQL,
    "op12_periodic_runs": runs.SQL,
    "op13_phrase_collocations": phrases.SQL,
}

if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
