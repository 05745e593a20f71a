"""The registered queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from corepick.llm import bpe, chat, classifier, decontaminate, langid, licenses, lines, merkle, near, quality, repair, suffix, warc

QUERIES = {
    "op1_order_minhash": near.op1_order_minhash,
    "op2_spaced_seeds": decontaminate.op2_spaced_seeds,
    "op3_bpe_rank_array": bpe.op3_bpe_rank_array,
    "op4_license_digest": licenses.op4_license_digest,
    "op5_chat_parts": chat.op5_chat_parts,
    "op6_fuzzy_lines": lines.op6_fuzzy_lines,
    "op7_line_frequency": quality.op7_line_frequency,
    "op8_rank_order_langid": langid.op8_rank_order_langid,
    "op9_warc_derivatives": warc.op9_warc_derivatives,
    "op10_suffix_array_dedup": suffix.op10_suffix_array_dedup,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_neighbour_votes": classifier.op12_neighbour_votes,
    "op13_block_table_repair": repair.op13_block_table_repair,
}

SQL = {
    "op4_license_digest": licenses.OP4_SQL,
    "op2_spaced_seeds": decontaminate.OP2_SQL,
    "op5_chat_parts": chat.OP5_SQL,
    "op7_line_frequency": quality.OP7_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
    "op13_block_table_repair": repair.OP13_SQL,
}
