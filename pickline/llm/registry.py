"""The operators of this subpackage as queries, with SQL where SQL can express them."""

from __future__ import annotations

from pickline.llm import (
    chat, exact, fill, grades, jaccard, middles, negatives, packages, phrases, prints, private, repeats, templates,
)

QUERIES = {
    "op1_exact_dedup": exact.op1_exact_dedup,
    "op2_decontamination": phrases.op2_decontamination,
    "op3_chat_format": chat.op3_chat_format,
    "op4_repeated_lines": repeats.op4_repeated_lines,
    "op5_web_packages": packages.op5_web_packages,
    "op6_line_templates": templates.op6_line_templates,
    "op7_pack": fill.op7_pack,
    "op8_personal_data": private.op8_personal_data,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_quality": grades.op10_quality,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_fill_in_middle": middles.op12_fill_in_middle,
    "op13_fingerprints": prints.op13_fingerprints,
}

ORACLES = {
    "op1_exact_dedup": exact.OP1_SQL,
    "op2_decontamination": phrases.OP2_SQL,
    "op4_repeated_lines": repeats.OP4_SQL,
    "op5_web_packages": packages.OP5_SQL,
    "op11_hard_negatives": negatives.OP11_SQL,
    "op12_fill_in_middle": middles.OP12_SQL,
}
