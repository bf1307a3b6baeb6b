"""The queries of this subpackage for the driver, and their SQL where SQL can express them."""

from __future__ import annotations

from palimpsest.llm import chat, exact_dedup, fingerprint, langid, mixing, packing, simhash, token_store, url_filter, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_fingerprint": fingerprint.op2_fingerprint,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_warc": warc.op4_warc,
    "op5_token_store": token_store.op5_token_store,
    "op6_simhash": simhash.op6_simhash,
    "op7_langid": langid.op7_langid,
    "op8_chat": chat.op8_chat,
    "op9_mixing": mixing.op9_mixing,
    "op10_packing": packing.op10_packing,
}

ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op4_warc": warc.ORACLE,
    "op8_chat": chat.ORACLE,
}
