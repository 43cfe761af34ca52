"""Registered queries of the subpackage: one per operator, with SQL where SQL can express it."""

from __future__ import annotations

from risklens.llm import (decontamination, language, merkle, mixing, near_duplicates, quality, token_counts, token_file, toxicity,
                          urls, vector_codes, vectors, warc)

QUERIES = {
    "op1_token_orc": token_file.op1_token_orc,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_quality": quality.op3_quality,
    "op4_jaccard_join": near_duplicates.op4_jaccard_join,
    "op5_mix": mixing.op5_mix,
    "op6_language": language.op6_language,
    "op7_exact_topk": vectors.op7_exact_topk,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_decontaminate": decontamination.op9_decontaminate,
    "op10_url_filter": urls.op10_url_filter,
    "op11_warc": warc.op11_warc,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_merkle": merkle.op13_merkle,
}

ORACLE_SQL = {
    "op4_jaccard_join": near_duplicates.OP4_SQL,
    "op5_mix": mixing.OP5_SQL,
    "op7_exact_topk": vectors.OP7_SQL,
    "op11_warc": warc.OP11_SQL,
    "op12_vector_codes": vector_codes.OP12_SQL,
    "op13_merkle": merkle.OP13_SQL,
}
