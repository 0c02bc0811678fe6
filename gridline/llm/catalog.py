"""The queries of this subpackage and their DuckDB text."""

from __future__ import annotations

from gridline.llm import centroids, chat, language, mixing, packing, quality, search, secrets, sharding, simhash, spelling, tokens, warc


def queries() -> dict:
    return {
        "op1_search": search.op1_search,
        "op2_simhash": simhash.op2_simhash,
        "op3_secrets": secrets.op3_secrets,
        "op4_sharding": sharding.op4_sharding,
        "op5_packing": packing.op5_packing,
        "op6_mixing": mixing.op6_mixing,
        "op7_tokens": tokens.op7_tokens,
        "op8_chat": chat.op8_chat,
        "op9_language": language.op9_language,
        "op10_quality": quality.op10_quality,
        "op11_warc": warc.op11_warc,
        "op12_centroids": centroids.op12_centroids,
        "op13_spelling": spelling.op13_spelling,
    }


def oracle_sql() -> dict:
    return {"op1_search": search.OP1_SQL, "op6_mixing": mixing.OP6_SQL, "op8_chat": chat.OP8_SQL, "op10_quality": quality.OP10_SQL, "op11_warc": warc.OP11_SQL, "op12_centroids": centroids.OP12_SQL}
