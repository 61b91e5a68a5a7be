"""The queries of this subpackage and their SQL, as __spark_entry__.py registers them."""

import corpus_pipeline
from lumenfold.llm import divergence, exact_dedup, fingerprints, html_text, merkle, mixing, near_dedup, packing, quality_rules, secrets, suffix_dedup, toxicity, url_filter

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_packing": packing.op2_packing,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_secrets": secrets.op6_secrets,
    "op7_html_text": html_text.op7_html_text,
    "op8_fingerprint": fingerprints.op8_fingerprint,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_divergence": divergence.op11_divergence,
    "op12_merkle": merkle.op12_merkle,
    "op13_quality_rules": quality_rules.op13_quality_rules,
    "pipeline": corpus_pipeline.run,
}

ORACLE = {**exact_dedup.ORACLE, **divergence.ORACLE, **merkle.ORACLE, **quality_rules.ORACLE, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}
