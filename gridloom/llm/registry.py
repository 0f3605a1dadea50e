"""Queries of this subpackage and the SQL that checks them, for the driver's entry module."""

from __future__ import annotations

from . import decontam, exact_dedup, ngram_join, packing, quality, secret_scan, tokenids, toxicity, url_filter, warc

QUERIES = {
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_ngram_jaccard": ngram_join.op4_ngram_jaccard,
    "op5_token_planes": tokenids.op5_token_planes,
    "op6_warc_index": warc.op6_warc_index,
    "op7_cgk_decontam": decontam.op7_cgk_decontam,
    "op8_compression_quality": quality.op8_compression_quality,
    "op9_radix_dedup": exact_dedup.op9_radix_dedup,
    "op10_toxicity_chain": toxicity.op10_toxicity_chain,
}

ORACLE_SQL: dict[str, str] = {
    "op3_url_filter": url_filter.OP3_SQL,
    "op4_ngram_jaccard": ngram_join.OP4_SQL,
    "op6_warc_index": warc.OP6_SQL,
    "op9_radix_dedup": exact_dedup.OP9_SQL,
}
