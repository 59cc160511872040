"""The queries of this subpackage, by name, and the SQL that states their results."""

from __future__ import annotations

from . import ann, bpe, chat, decontaminate, fim, langid, licenses, linededup, lmscore, neardup, periodic, secrets, toxicity

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_language_id": langid.op2_language_id,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_nearest": ann.op4_nearest,
    "op5_line_dedup": linededup.op5_line_dedup,
    "op6_near_duplicates": neardup.op6_near_duplicates,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_lm_score": lmscore.op8_lm_score,
    "op9_secrets": secrets.op9_secrets,
    "op10_bpe": bpe.op10_bpe,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_fill_in_middle": fim.op12_fill_in_middle,
    "op13_chat_format": chat.op13_chat_format,
}

SQL = {
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op5_line_dedup": linededup.OP5_SQL,
    "op6_near_duplicates": neardup.OP6_SQL,
    "op12_fill_in_middle": fim.OP12_SQL,
    "op13_chat_format": chat.OP13_SQL,
}
