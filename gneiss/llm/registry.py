"""The corpus queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from gneiss.llm import chat, classifier, decontam, langid, linededup, lmscore, mixing, quality_rules, simhash, warc

QUERIES = {
    "op6_warc": warc.op6_warc,
    "op7_lm_score": lmscore.op7_lm_score,
    "op3_language_id": langid.op3_language_id,
    "op5_quality_classifier": classifier.op5_quality_classifier,
    "op4_decontamination": decontam.op4_decontamination,
    "op1_simhash": simhash.op1_simhash,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op8_chat_format": chat.op8_chat_format,
    "op9_mixing": mixing.op9_mixing,
    "op10_line_dedup": linededup.op10_line_dedup,
}

SQL = {
    "op4_decontamination": decontam.OP4_SQL,
    "op2_quality_rules": quality_rules.OP2_SQL,
    "op6_warc": warc.OP6_SQL,
    "op8_chat_format": chat.OP8_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op10_line_dedup": linededup.OP10_SQL,
}
