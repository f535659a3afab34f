"""The queries of this subpackage and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from tapeloom.llm import audio, embedding_dedup, infilling, language, merkle, mixing, packing, pieces, quality, sharding, simhash, token_counts, warc

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_sharding": sharding.op2_sharding,
    "op3_quality": quality.op3_quality,
    "op4_audio": audio.op4_audio,
    "op5_embedding_dedup": embedding_dedup.op5_embedding_dedup,
    "op6_language": language.op6_language,
    "op7_warc": warc.op7_warc,
    "op8_packing": packing.op8_packing,
    "op9_mixing": mixing.op9_mixing,
    "op10_simhash": simhash.op10_simhash,
    "op11_infilling": infilling.op11_infilling,
    "op12_merkle": merkle.op12_merkle,
    "op13_pieces": pieces.op13_pieces,
}
ORACLES = {
    "op7_warc": warc.OP7_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op11_infilling": infilling.OP11_SQL,
    "op12_merkle": merkle.OP12_SQL,
}
