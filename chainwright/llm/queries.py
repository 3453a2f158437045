"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from chainwright.llm import bpe, chat, decontaminate, jaccard, language, nearest, packing, phrases, pii, quality, secrets, warc, whitening

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_secrets": secrets.op4_secrets,
    "op5_bpe": bpe.op5_bpe,
    "op6_language_id": language.op6_language_id,
    "op7_nearest": nearest.op7_nearest,
    "op8_quality": quality.op8_quality,
    "op9_warc": warc.op9_warc,
    "op10_jaccard_join": jaccard.op10_jaccard_join,
    "op11_whitening": whitening.op11_whitening,
    "op12_packing": packing.op12_packing,
    "op13_phrases": phrases.op13_phrases,
}
SQL = {
    "op1_pii": pii.SQL,
    "op2_decontamination": decontaminate.SQL,
    "op3_chat_formatting": chat.SQL,
    "op9_warc": warc.SQL,
    "op10_jaccard_join": jaccard.SQL,
    "op13_phrases": phrases.SQL,
}
