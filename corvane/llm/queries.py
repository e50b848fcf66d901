"""The queries of this folder, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from corvane.llm import bpe, chat, langid, lines, packing, pii, quality, simhash, topk, warc

QUERIES = {
    "op1_line_dedup": lines.query,
    "op2_warc": warc.query,
    "op3_packing": packing.query,
    "op4_byte_bpe": bpe.query,
    "op5_chat_windows": chat.query,
    "op6_pii": pii.query,
    "op7_language": langid.query,
    "op8_quality_rules": quality.query,
    "op9_exact_topk": topk.query,
    "op10_simhash": simhash.query,
}
ORACLES = {
    "op2_warc": warc.sql(),
    "op5_chat_windows": chat.sql(),
    "op8_quality_rules": quality.sql(),
    "op9_exact_topk": topk.sql(),
}
