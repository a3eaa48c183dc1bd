"""The queries of the training-data operators, by name, and their SQL where SQL can express them."""

from . import conversation_repair, exact_dedup, line_crf, manifest, mixing, near_dedup, ngram_join, packing, quality_rules, sharding, substring_dedup, token_files, toxicity

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_packing": packing.op2_packing,
    "op3_quality_classifier": line_crf.op3_quality_classifier,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_token_files": token_files.op5_token_files,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_ngram_join": ngram_join.op11_ngram_join,
    "op12_merkle_manifest": manifest.op12_merkle_manifest,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}

SQL = {
    "op4_substring_dedup": substring_dedup.OP4_SQL,
    "op6_near_dedup": near_dedup.OP6_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op11_ngram_join": ngram_join.OP11_SQL,
    "op12_merkle_manifest": manifest.OP12_SQL,
    "op13_conversation_repair": conversation_repair.OP13_SQL,
}
