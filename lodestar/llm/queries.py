"""Queries of this subpackage: name -> function of (spark, sf_dir), and SQL where it can express them."""

from lodestar.llm import exact_dedup, html_text, language_id, line_dedup, lm_scoring, mixing, near_join, neighbours, packing, warc

QUERIES = {
    "op1_best_fit_packing": packing.op1,
    "op2_multi_index_hashing": neighbours.op2,
    "op3_exact_dedup": exact_dedup.op3,
    "op4_html_text": html_text.op4,
    "op5_warc": warc.op5,
    "op6_language_id": language_id.op6,
    "op7_mixing": mixing.op7,
    "op8_line_dedup": line_dedup.op8,
    "op9_lm_scoring": lm_scoring.op9,
    "op10_ngram_jaccard": near_join.op10,
}
ORACLE_SQL = {"op3_exact_dedup": exact_dedup.SQL}
