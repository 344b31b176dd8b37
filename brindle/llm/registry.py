"""The subpackage's registered queries and their SQL, one query per operator."""

from __future__ import annotations

from brindle.llm import chat, decontaminate, hpylm, langid, licenses, mixing, omh, secrets, sharding, simhash


def queries() -> dict:
    return {"op1_hpylm": hpylm.query, "op2_langid": langid.query, "op3_mixing": mixing.query, "op4_simhash": simhash.query, "op5_omh": omh.query, "op6_sharding": sharding.query, "op7_secrets": secrets.query, "op8_licenses": licenses.query, "op9_chat": chat.query, "op10_decontaminate": decontaminate.query}


def oracle_sql() -> dict[str, str]:
    return {"op8_licenses": licenses.SQL, "op9_chat": chat.SQL}
