"""Names of the training-data queries and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import idstore, lines, mixing, packing, phrases, pii, quality, search, secrets, simhash, suffixes, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_string_kernel_toxicity": toxicity.op1_string_kernel_toxicity,
        "op2_trigram_secrets": secrets.op2_trigram_secrets,
        "op3_mph_idstore": idstore.op3_mph_idstore,
        "op4_hilbert_packing": packing.op4_hilbert_packing,
        "op5_two_stage_suffix_dedup": suffixes.op5_two_stage_suffix_dedup,
        "op6_boosted_pii": pii.op6_boosted_pii,
        "op7_line_quality": quality.op7_line_quality,
        "op8_simhash_components": simhash.op8_simhash_components,
        "op9_wfq_mixing": mixing.op9_wfq_mixing,
        "op10_phrase_fingerprints": phrases.op10_phrase_fingerprints,
        "op11_bloom_lines": lines.op11_bloom_lines,
        "op12_impact_search": search.op12_impact_search,
    }


def oracle_sql() -> dict[str, str]:
    """The other operators' results rest on hashes, models or a tokenizer that SQL hasn't; the tests compare them with brute force."""
    return {"op9_wfq_mixing": mixing.OP9_SQL, "op11_bloom_lines": lines.OP11_SQL, "op12_impact_search": search.OP12_SQL}
