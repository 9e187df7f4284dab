"""Queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from ohmgrid.llm import decontaminate, embeddings, importance, merkle, packing, pii, repeats, secret_ledger, simhash, token_counts, toxicity, url_rules, warc

QUERIES = {
    "op1_pseudonyms": pii.op1_pseudonyms,
    "op2_simhash": simhash.op2_simhash,
    "op3_packing": packing.op3_packing,
    "op4_embeddings": embeddings.op4_embeddings,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_repeats": repeats.op8_repeats,
    "op9_url_rules": url_rules.op9_url_rules,
    "op10_secret_ledger": secret_ledger.op10_secret_ledger,
    "op11_importance": importance.op11_importance,
    "op12_warc": warc.op12_warc,
    "op13_merkle": merkle.op13_merkle,
}

ORACLES = {
    "op6_decontaminate": decontaminate.ORACLE_SQL,
    "op9_url_rules": url_rules.ORACLE_SQL,
    "op12_warc": warc.ORACLE_SQL,
    "op13_merkle": merkle.ORACLE_SQL,
}
