"""Building blocks of parsed documents: one struct column per format.

A parser is a function ``text column -> struct(blocks, tables, warnings, error)``. Uploads
are capped in size, so a whole document fits in one row by rule.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirefold.schemas import BLOCKS, PARSED, TABLES


def block(text: Column, kind: str, location: Column | None = None, heading: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        text.alias("text"), F.lit(kind).alias("kind"),
        (null if location is None else location).alias("location"),
        (null if heading is None else heading).alias("heading"),
    )


def result(blocks: Column, tables: Column | None = None, warnings: Column | None = None, error: Column | None = None) -> Column:
    return F.struct(
        blocks.cast(BLOCKS).alias("blocks"),
        (F.array() if tables is None else tables).cast(TABLES).alias("tables"),
        (F.array() if warnings is None else warnings).cast("array<string>").alias("warnings"),
        (F.lit(None) if error is None else error).cast("string").alias("error"),
    ).cast(PARSED)


def failed(reason) -> Column:
    return result(F.array(), error=reason if isinstance(reason, Column) else F.lit(reason))


def joined_rows(rows: Column, separator: str) -> Column:
    """Rows of cells as text, one line per row."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, separator)), "\n")
