"""The registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from foldstone.llm import chat, embedding_dedup, line_dedup, mixing, sentencepiece_fst, sharding, simhash, topk, toxicity, url_filter

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_embedding_dedup": embedding_dedup.op2_embedding_dedup,
    "op3_sentencepiece": sentencepiece_fst.op3_sentencepiece,
    "op4_chat_format": chat.op4_chat_format,
    "op5_sharding": sharding.op5_sharding,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_mixing": mixing.op7_mixing,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_simhash": simhash.op9_simhash,
    "op10_topk": topk.op10_topk,
}

ORACLE_SQL = {
    "op1_line_dedup": line_dedup.ORACLE_SQL,
    "op2_embedding_dedup": embedding_dedup.ORACLE_SQL,
    "op4_chat_format": chat.ORACLE_SQL,
    "op7_mixing": mixing.ORACLE_SQL,
    "op8_url_filter": url_filter.ORACLE_SQL,
    "op10_topk": topk.ORACLE_SQL,
}
