"""Queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, hamming, htmltext, jaccard, neardup, packing, periods, phrases, pii, secrets, toxicity, urlfilter, variants


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": bpe.op1_bpe,
        "op2_near_duplicate_vectors": neardup.op2_near_duplicate_vectors,
        "op3_secrets": secrets.op3_secrets,
        "op4_url_filter": urlfilter.op4_url_filter,
        "op5_pii": pii.op5_pii,
        "op6_packing": packing.op6_packing,
        "op7_jaccard_join": jaccard.op7_jaccard_join,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_html_text": htmltext.op9_html_text,
        "op10_hamming_top_k": hamming.op10_hamming_top_k,
        "op11_periodic_runs": periods.op11_periodic_runs,
        "op12_spelling_variants": variants.op12_spelling_variants,
        "op13_document_fingerprints": phrases.op13_document_fingerprints,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_near_duplicate_vectors": neardup.OP2_SQL,
        "op4_url_filter": urlfilter.OP4_SQL,
        "op7_jaccard_join": jaccard.OP7_SQL,
        "op10_hamming_top_k": hamming.OP10_SQL,
    }
