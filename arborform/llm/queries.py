"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import q_alignment, q_bpe_trie, q_decontaminate, q_interleave, q_jaccard_join, q_language, q_linkrank, q_mixing, q_secrets, q_spelling, q_token_table, q_toxicity, q_weighted_sampling


def _all():
    return {"op1_secrets": (q_secrets.op1_secrets, q_secrets.SQL),
            "op2_language": (q_language.op2_language, None),
            "op3_linkrank": (q_linkrank.op3_linkrank, q_linkrank.SQL),
            "op4_toxicity": (q_toxicity.op4_toxicity, None),
            "op5_jaccard_join": (q_jaccard_join.op5_jaccard_join, q_jaccard_join.SQL),
            "op6_token_table": (q_token_table.op6_token_table, None),
            "op7_interleave": (q_interleave.op7_interleave, q_interleave.SQL),
            "op8_weighted_sampling": (q_weighted_sampling.op8_weighted_sampling, None),
            "op9_decontaminate": (q_decontaminate.op9_decontaminate, None),
            "op10_mixing": (q_mixing.op10_mixing, q_mixing.SQL),
            "op11_spelling": (q_spelling.op11_spelling, q_spelling.SQL),
            "op12_bpe_trie": (q_bpe_trie.op12_bpe_trie, None),
            "op13_alignment": (q_alignment.op13_alignment, None)}


def queries():
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql():
    return {k: sql for k, (_, sql) in _all().items() if sql}
