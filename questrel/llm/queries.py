"""The subpackage's queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import embeddings, minhash, mixing, packing, quality, sentences, suffixes, syncmers, toxicity, warc

QUERIES = {
    "op1_order_minhash": minhash.op1_order_minhash,
    "op10_sentence_spans": sentences.op10_sentence_spans,
    "op2_bwt_intervals": suffixes.op2_bwt_intervals,
    "op3_cross_polytope": embeddings.op3_cross_polytope,
    "op4_warc_from_arc": warc.op4_warc_from_arc,
    "op5_bm25_packing": packing.op5_bm25_packing,
    "op6_pareto_mixing": mixing.op6_pareto_mixing,
    "op7_subword_toxicity": toxicity.op7_subword_toxicity,
    "op8_closed_syncmers": syncmers.op8_closed_syncmers,
    "op9_ordinal_quality": quality.op9_ordinal_quality,
}

SQL = {
    "op6_pareto_mixing": mixing.SQL,
}
