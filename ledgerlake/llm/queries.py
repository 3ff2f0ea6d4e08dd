"""The subpackage's queries and their SQL."""

from __future__ import annotations

from ledgerlake.llm import bpe, chunking, conversation, exact_dedup, media, ngram_join, periodic, quality, secrets, source_mix, stream_bpe, suffix_dedup, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_bpe": bpe.op2_bpe,
    "op3_secrets": secrets.op3_secrets,
    "op4_quality": quality.op4_quality,
    "op5_source_mix": source_mix.op5_source_mix,
    "op6_media": media.op6_media,
    "op7_chunk_dedup": chunking.op7_chunk_dedup,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_ngram_join": ngram_join.op9_ngram_join,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_conversation_repair": conversation.op12_conversation_repair,
    "op13_stream_bpe": stream_bpe.op13_stream_bpe,
}

ORACLE_SQL = {
    "op1_warc": warc.OP1_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
}
