"""The queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rangeparts.llm import audio, licenses, linededup, packing, pieces, quality, simhash, sitestyle, toxicity, winnowing
from rangeparts.llm.common import table


def op1_site_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of `pages`: (page_id, url, text, n_chars)."""
    return sitestyle.main_texts(table(spark, sf_dir, "pages"))


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of `documents` and of their edited texts, with likenesses."""
    return winnowing.compared(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of `documents` that repeat earlier ones: (doc_id, n_lines, exact_lines, near_lines, first_docs)."""
    return linededup.report(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of `documents`, learned from `labels`: (doc_id, held_out, score, predicted)."""
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def byte_bpe() -> str:
    """The vocabulary file that documents are packed with."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as tokens, packed into sequences: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return packing.packed(table(spark, sf_dir, "documents"), byte_bpe())


def op6_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as sound files, read back, with a digest of their features."""
    return audio.digests(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled segmentations of `documents`, decoded again: (doc_id, n_chars, n_pieces, ids_sha256, lossless)."""
    import public_tokenizers

    return pieces.round_trips(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and texts in `documents`."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of `documents`, learned from `labels`: (doc_id, held_out, score, predicted)."""
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of `documents`: (doc_id, fingerprint, component_id)."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_site_style": op1_site_style,
    "op2_winnowing": op2_winnowing,
    "op3_line_dedup": op3_line_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_packing": op5_packing,
    "op6_audio": op6_audio,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_licenses": op8_licenses,
    "op9_quality": op9_quality,
    "op10_simhash": op10_simhash,
}

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": linededup.REPORT_SQL,
    "op8_licenses": licenses.scan_sql(),
}
