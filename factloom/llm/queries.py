"""The registered corpus queries and their SQL oracles."""

from . import ann, byte_bpe, importance, line_dedup, near_dedup, packing, quality_classifier, quality_rules, sharding, spelling, substring_dedup, tokens, url_filter

QUERIES = {
    "op1_packing": packing.op1_query,
    "op2_quality_classifier": quality_classifier.op2_query,
    "op3_quality_rules": quality_rules.op3_query,
    "op4_token_counts": tokens.op4_query,
    "op5_byte_bpe": byte_bpe.op5_query,
    "op6_line_dedup": line_dedup.op6_query,
    "op7_nearest_neighbours": ann.op7_query,
    "op8_sharding": sharding.op8_query,
    "op9_substring_dedup": substring_dedup.op9_query,
    "op10_near_dedup": near_dedup.op10_query,
    "op11_url_filter": url_filter.op11_query,
    "op12_importance_resampling": importance.op12_query,
    "op13_spelling_variants": spelling.op13_query,
}
ORACLES = {
    "op3_quality_rules": quality_rules.OP3_SQL,
    "op6_line_dedup": line_dedup.OP6_SQL,
    "op9_substring_dedup": substring_dedup.OP9_SQL,
    "op10_near_dedup": near_dedup.OP10_SQL,
    "op11_url_filter": url_filter.OP11_SQL,
}
