"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from edgeloom.llm import align, chats, embed_dups, hamming_topk, html_text, language, mixing, periodic, pieces, quality, shingle_join, token_files, toxicity


def queries() -> dict:
    return {
        "op1_embed_dups": embed_dups.op1_embed_dups,
        "op2_pieces": pieces.op2_pieces,
        "op3_ngram_jaccard": shingle_join.op3_ngram_jaccard,
        "op4_language": language.op4_language,
        "op5_source_mix": mixing.op5_source_mix,
        "op6_token_files": token_files.op6_token_files,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_html_text": html_text.op8_html_text,
        "op9_hamming_topk": hamming_topk.op9_hamming_topk,
        "op10_quality": quality.op10_quality,
        "op11_periodic_runs": periodic.op11_periodic_runs,
        "op12_chat_format": chats.op12_chat_format,
        "op13_token_alignment": align.op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_hamming_topk": hamming_topk.SQL, "op12_chat_format": chats.SQL}
