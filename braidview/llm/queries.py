"""The queries of this subpackage and their SQL, for the entry module at the repository top."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, fim, htmltext, jaccard, langid, linededup, merkle, oracles, pieces, quality, suffixdedup, toxicity, warc
from .common import table


def _on(run: Callable[..., DataFrame], *names: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(*[table(spark, sf_dir, n) for n in names])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": _on(pieces.query, "documents"),
        "op10_jaccard_join": _on(jaccard.query, "documents"),
        "op11_merkle_manifest": _on(merkle.query, "documents"),
        "op12_fill_in_middle": _on(fim.query, "documents"),
        "op13_language_id": _on(langid.query, "documents"),
        "op2_line_dedup": _on(linededup.query, "documents"),
        "op3_chat_formatting": _on(chat.query, "conversations"),
        "op4_suffix_array_dedup": _on(suffixdedup.query, "documents"),
        "op5_quality_rules": _on(quality.query, "documents", "labels"),
        "op6_toxicity": _on(toxicity.query, "documents", "labels"),
        "op7_warc": _on(warc.query, "pages"),
        "op8_html_extraction": _on(htmltext.query, "pages"),
        "op9_decontamination": _on(decontaminate.query, "documents", "benchmark"),
    }


def oracle_sql() -> dict[str, str]:
    """The others rest on learned models, piece tables or page rules, or (op4) take SQL minutes on small tables; tests hold them against brute force."""
    return {
        "op2_line_dedup": oracles.LINE_DEDUP,
        "op7_warc": oracles.WARC,
        "op9_decontamination": oracles.DECONTAMINATION,
        "op10_jaccard_join": oracles.JACCARD,
        "op11_merkle_manifest": oracles.MERKLE,
        "op12_fill_in_middle": oracles.FIM,
    }
