"""Rows of a table or query as documents."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookwright.errors import RowSourceError
from bookwright.functions.text import stripped


@dataclass(frozen=True)
class RowMapping:
    """Which columns of a row are its id, title, details and text. ``label`` names the source."""

    label: str
    id_column: str
    text_columns: tuple[str, ...]
    title_column: str | None = None
    meta_columns: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[A-Za-z0-9._-]{1,64}", self.label):
            raise RowSourceError("a label is 1 to 64 letters, digits, '.', '_' or '-'")
        if not self.text_columns:
            raise RowSourceError("at least one text column is needed")

    @property
    def prefix(self) -> str:
        return f"sql:{self.label}/"

    @property
    def columns(self) -> list[str]:
        named = [self.id_column, *self.text_columns, *self.meta_columns, *([self.title_column] if self.title_column else [])]
        return list(dict.fromkeys(named))


def _filled(name: str) -> Column:
    """A value as text, null if it is null or empty."""
    return F.nullif(F.col(name).cast("string"), F.lit(""))


def documents(rows: DataFrame, mapping: RowMapping, strict: bool = True) -> DataFrame:
    """``source_path``, ``source_name``, ``text``: every row with text as a markdown document.

    Title, details and texts are parts with a blank line between; of several
    text columns each has its name as a heading. Rows whose texts are all null
    or blank are left out. A null id fails the job; without ``strict`` such rows
    are left out. Missing columns fail at once. Other columns don't matter.
    """
    missing = [c for c in mapping.columns if c not in rows.columns]
    if missing:
        raise RowSourceError(f"the rows have no column {', '.join(missing)}")
    id_ = F.col(mapping.id_column).cast("string")
    title = F.nullif(stripped(_filled(mapping.title_column)), F.lit("")) if mapping.title_column else F.lit(None).cast("string")
    details = [F.concat(F.lit(f"{c}: "), _filled(c)) for c in mapping.meta_columns]
    detail = F.nullif(F.concat_ws("\n", *details), F.lit("")) if details else F.lit(None).cast("string")
    texts = {c: F.nullif(stripped(_filled(c)), F.lit("")) for c in mapping.text_columns}
    bodies = [t if len(texts) == 1 else F.concat(F.lit(f"## {c}\n\n"), t) for c, t in texts.items()]
    kept = rows.where(F.coalesce(*texts.values()).isNotNull())
    if strict:
        id_ = F.coalesce(id_, F.raise_error(F.lit(f"a row has no {mapping.id_column}")).cast("string"))
    else:
        kept = kept.where(F.col(mapping.id_column).isNotNull())
    return kept.select(
        F.concat(F.lit(mapping.prefix), id_).alias("source_path"),
        F.coalesce(title, F.concat(F.lit(f"{mapping.label} #"), id_)).alias("source_name"),
        F.concat_ws("\n\n", F.concat(F.lit("# "), title), detail, *bodies).alias("text"),
    )


def duplicates(found: DataFrame) -> DataFrame:
    """``source_path`` and ``n`` of paths that several documents have."""
    return found.groupBy("source_path").agg(F.count("*").alias("n")).where("n > 1")


def checked(found: DataFrame) -> DataFrame:
    """``found``, after making sure that no path occurs twice."""
    twice = duplicates(found).orderBy("source_path").take(1)
    if twice:
        raise RowSourceError(f"duplicate id {twice[0]['source_path']!r}: ids must be unique")
    return found


def latest(rows: DataFrame, id_column: str, order_column: str) -> DataFrame:
    """Of rows with one id only the last by ``order_column``; of equal rows one."""
    newest = Window.partitionBy(id_column).orderBy(F.desc_nulls_last(order_column), *[F.desc_nulls_last(c) for c in rows.columns if c not in (id_column, order_column)])
    return rows.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")
