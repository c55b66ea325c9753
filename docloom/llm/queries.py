"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import bpe_tree, decontaminate, fim, html_crf, kneser_ney, langid, media, merkle_manifest, neardup, pii, sql, token_files, url_templates, warc_fixity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_webp": media.op1_webp,
        "op2_url_templates": url_templates.op2_url_templates,
        "op3_winnowing": decontaminate.op3_winnowing,
        "op4_pii_surrogates": pii.op4_pii_surrogates,
        "op5_merkle_fixity": warc_fixity.op5_merkle_fixity,
        "op6_kneser_ney": kneser_ney.op6_kneser_ney,
        "op7_minhash_join": neardup.op7_minhash_join,
        "op8_token_files": token_files.op8_token_files,
        "op9_bpe_tree": bpe_tree.op9_bpe_tree,
        "op10_language_id": langid.op10_language_id,
        "op11_fill_in_middle": fim.op11_fill_in_middle,
        "op12_html_crf": html_crf.op12_html_crf,
        "op13_merkle_manifest": merkle_manifest.op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return sql.ORACLES
