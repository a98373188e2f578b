"""Queries of the corpus operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from lumenframe.llm import codes, langid, mixing, neighbours, ngrams, packing, simhash, suffix, topk, toxicity, trie, urlfilter, warc

QUERIES = {
    "op1_toxicity": toxicity.op1,
    "op2_suffix_dedup": suffix.op2,
    "op3_exact_top_k": topk.op3,
    "op4_source_mixing": mixing.op4,
    "op5_language_id": langid.op5,
    "op6_simhash_groups": simhash.op6,
    "op7_url_filter": urlfilter.op7,
    "op8_packing": packing.op8,
    "op9_neighbours": neighbours.op9,
    "op10_warc": warc.op10,
    "op11_vector_codes": codes.op11,
    "op12_ngram_join": ngrams.op12,
    "op13_conversation_trie": trie.op13,
}
ORACLES: dict[str, str] = {
    "op3_exact_top_k": topk.SQL,
    "op4_source_mixing": mixing.SQL,
    "op7_url_filter": urlfilter.SQL,
    "op10_warc": warc.SQL,
    "op11_vector_codes": codes.SQL,
    "op12_ngram_join": ngrams.SQL,
    "op13_conversation_trie": trie.SQL,
}
