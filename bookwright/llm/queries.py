"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bookwright.llm import copies, encoding, lookalikes, mixing, neardup, neighbors, ocr_repair, splitting
from bookwright.llm.oracle import SQL
from bookwright.sources.tables import table

#: Folder of the public vocabularies.
TOKENIZERS = os.environ.get("BOOKWRIGHT_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


def _scans(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    chunks = table(spark, folder, "chunks", "id", "document_id", "text", "section_title", "heading_path", "page_start", "page_end")
    return chunks, table(spark, folder, "documents", "doc_id", "ocr_used", "source_name")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return ocr_repair.noise(*_scans(spark, folder))


def p1_text(spark: SparkSession, folder: str) -> DataFrame:
    return ocr_repair.repaired(*_scans(spark, folder))


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return neighbors.vectors(table(spark, folder, "chunks", "id", "document_id", "embedding"), table(spark, folder, "documents", "doc_id", "collection"), table(spark, folder, "collections"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbors.similar_pairs(_vectors(spark, folder))


def p2_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbors.neighbours(_vectors(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.oversized(table(spark, folder, "chunks", "id", "text"))


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.pieces(table(spark, folder, "chunks", "id", "text", "heading_path"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return copies.found(table(spark, folder, "chunks", "id", "text"), table(spark, folder, "documents", "doc_id", "source_hash"))


def p4_records(spark: SparkSession, folder: str) -> DataFrame:
    return copies.records(table(spark, folder, "chunks", "id", "text"))


def p4_all_records(spark: SparkSession, folder: str) -> DataFrame:
    return copies.all_records(table(spark, folder, "chunks", "id", "text"), table(spark, folder, "documents", "doc_id", "source_hash"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.similar_pairs(table(spark, folder, "chunks", "id", "text"))


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.groups(table(spark, folder, "chunks", "id", "text"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.encode(table(spark, folder, "documents", "doc_id", "text"), VOCABULARY)


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents", "doc_id", "source", "text"), table(spark, folder, "source_targets"), VOCABULARY, mixing.CORPUS)[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents", "doc_id", "source", "text"), table(spark, folder, "source_targets"), VOCABULARY, mixing.CORPUS)[1]


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalikes.same_look(table(spark, folder, "documents", "doc_id", "text"))


def p8_looks(spark: SparkSession, folder: str) -> DataFrame:
    return lookalikes.looks(table(spark, folder, "documents", "doc_id", "text"))


def p8_canonical(spark: SparkSession, folder: str) -> DataFrame:
    return lookalikes.canonical(table(spark, folder, "documents", "doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_text, p2_found, p2_neighbours, p3_found, p3_pieces, p4_found, p4_records, p4_all_records, p5_found, p5_groups, p6_ids, p7_mix, p7_shares, p8_found, p8_looks, p8_canonical)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
