"""The queries of this folder by name, and their SQL where SQL can say it."""

from . import exact_dedup, fingerprint, html_extract, line_dedup, packing, prefix_trie, quality, simhash_dedup, tokens, url_filter, vector_codes, vector_search

_MODULES = {
    "op1_line_dedup": line_dedup,
    "op2_url_filter": url_filter,
    "op4_fingerprint": fingerprint,
    "op5_html_extract": html_extract,
    "op6_simhash_dedup": simhash_dedup,
    "op7_packing": packing,
    "op8_exact_dedup": exact_dedup,
    "op10_quality": quality,
    "op11_nearest_vectors": vector_search,
    "op12_conversation_trie": prefix_trie,
    "op13_vector_codes": vector_codes,
}

QUERIES = {name: m.query for name, m in _MODULES.items()} | {
    "op3_bpe_encode": tokens.query_encode,
    "op9_token_count": tokens.query_count,
}
ORACLE_SQL = {name: m.SQL for name, m in _MODULES.items() if getattr(m, "SQL", None)}
