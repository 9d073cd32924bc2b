"""The queries of the corpus operators, and their SQL where SQL can express them."""

from presentia.llm import bpe, collocations, html_text, kneser_ney, line_dedup, mixing, order_minhash, pitman_yor, quality_rules, simhash, token_counts, toxicity, vector_codes

QUERIES = {
    "op1_simhash_near_dedup": simhash.query,
    "op2_quality_rules": quality_rules.query,
    "op3_mix_sources": mixing.query,
    "op4_pitman_yor": pitman_yor.query,
    "op5_byte_bpe": bpe.query,
    "op6_line_dedup": line_dedup.query,
    "op7_kneser_ney": kneser_ney.query,
    "op8_html_text": html_text.query,
    "op9_toxicity": toxicity.query,
    "op10_order_minhash": order_minhash.query,
    "op11_vector_codes": vector_codes.query,
    "op12_collocations": collocations.query,
    "op13_token_counts": token_counts.query,
}

#: The other operators hash, sample or learn in ways that SQL has no words for; tests/llm has their brute-force versions.
ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": quality_rules.oracle_sql(),
    "op11_vector_codes": vector_codes.oracle_sql(),
    "op12_collocations": collocations.oracle_sql(),
}
