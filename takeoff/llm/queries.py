"""The registered queries of this subpackage and their SQL."""

from takeoff.llm import alignment, decontamination, language, licenses, oracles, packing, quality_classifier, quality_rules, secrets, simhash, suffix_dedup, warc, whitening, wrappers

QUERIES = {f.__name__: f for f in (
    suffix_dedup.op1_suffix_array_dedup,
    simhash.op2_simhash_near_dedup,
    quality_rules.op3_isolation_forest_rules,
    decontamination.op4_positional_index_decontamination,
    language.op5_string_kernel_language,
    packing.op6_sum_of_squares_packing,
    secrets.op7_random_forest_secret_scan,
    wrappers.op8_wrapper_html_extraction,
    quality_classifier.op9_sparse_rule_quality,
    licenses.op10_template_license_scan,
    whitening.op11_chebyshev_whitening,
    warc.op12_warc_transactions,
    alignment.op13_tokenizer_alignment,
)}

ORACLES = {k: v for k, v in oracles.ORACLES.items() if k in QUERIES}
