"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, fill_middle, language_id, line_dedup, mixing, piece_codec, quality_model, quality_rules, simhash, suffix_dedup, token_pack, warc, whitening

QUERIES = {
    "op1_token_pack": token_pack.op1_token_pack,
    "op2_quality_model": quality_model.op2_quality_model,
    "op3_simhash": simhash.op3_simhash,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_warc": warc.op5_warc,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_mixing": mixing.op7_mixing,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_language_id": language_id.op10_language_id,
    "op11_whitening": whitening.op11_whitening,
    "op12_piece_codec": piece_codec.op12_piece_codec,
    "op13_fill_middle": fill_middle.op13_fill_middle,
}

ORACLES: dict[str, str] = {
    "op5_warc": warc.OP5_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
    "op13_fill_middle": fill_middle.OP13_SQL,
}
