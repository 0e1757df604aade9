"""The queries of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import audio, bpe, chat_format, fingerprint, html_text, line_dedup, minhash, mixing, periodic, quality, spelling, token_file, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chroma": audio.op1_chroma,
        "op2_line_dedup": line_dedup.op2_line_dedup,
        "op3_html_text": html_text.op3_html_text,
        "op4_prob_minhash": minhash.op4_prob_minhash,
        "op5_closed_syncmers": fingerprint.op5_closed_syncmers,
        "op6_chat_format": chat_format.op6_chat_format,
        "op7_token_file": token_file.op7_token_file,
        "op8_mix_sources": mixing.op8_mix_sources,
        "op9_bpe": bpe.op9_bpe,
        "op10_quality": quality.op10_quality,
        "op11_warc": warc.op11_warc,
        "op12_periodic_runs": periodic.op12_periodic_runs,
        "op13_spelling_variants": spelling.op13_spelling_variants,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": line_dedup.OP2_SQL, "op6_chat_format": chat_format.OP6_SQL, "op8_mix_sources": mixing.OP8_SQL}
