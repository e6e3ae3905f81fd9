"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from papyra.llm import chat, langid, line_dedup, media, mixing, neardup, packing, topk, urls, warc


def queries() -> dict:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_warc": warc.op2_warc,
        "op3_mixing": mixing.op3_mixing,
        "op4_media": media.op4_media,
        "op5_url_filter": urls.op5_url_filter,
        "op6_chat": chat.op6_chat,
        "op7_language_id": langid.op7_language_id,
        "op8_near_duplicates": neardup.op8_near_duplicates,
        "op9_topk": topk.op9_topk,
        "op10_packing": packing.op10_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.OP1_SQL,
        "op2_warc": warc.OP2_SQL,
        "op6_chat": chat.OP6_SQL,
        "op9_topk": topk.OP9_SQL,
    }
