"""Typed filters, sorts and pages over one extracted table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions import text as tx
from quirefold.operators.ranking import place_in_group, top_k
from quirefold.session import broadcast_if_small


def cell(index: int) -> Column:
    """Cell ``index`` of a row; a short row reads as an empty string."""
    return F.coalesce(F.get("cells", F.lit(index)), F.lit(""))


def _python_number(text: str) -> float | None:
    try:
        return float(text.replace(",", "").rstrip("%"))
    except ValueError:
        return None


def filter_rows(rows: DataFrame, columns: list[tuple[str, str]], col: str | None, op: str, val: str | None) -> DataFrame:
    """Keep the rows whose cell satisfies (col, op, val); an unknown column or empty value keeps all."""
    names = [n for n, _ in columns]
    if not col or col not in names or val in (None, ""):
        return rows
    i = names.index(col)
    if columns[i][1] == "number":
        target = _python_number(val)
        if target is None:
            return rows.filter(F.lit(False))
        number = tx.coerce_number(cell(i))
        test = {
            "gte": number >= target,
            "lte": number <= target,
            "eq": number == target,
            "contains": F.lower(cell(i)).contains(str(target)),
        }.get(op, F.lit(True))
        return rows.filter(number.isNotNull() & test)
    low, wanted = F.lower(cell(i)), val.lower()
    return rows.filter(low == wanted if op == "eq" else low.contains(wanted))


def sort_keys(columns: list[tuple[str, str]], sort: str | None, direction: str = "asc") -> list[Column]:
    """Sort expressions; equal keys keep the row order in both directions."""
    names = [n for n, _ in columns]
    if not sort or sort not in names:
        return [F.asc("row_index")]
    i = names.index(sort)
    key = F.coalesce(tx.coerce_number(cell(i)), F.lit(0.0)) if columns[i][1] == "number" else F.lower(cell(i))
    return [key.desc() if direction == "desc" else key.asc(), F.asc("row_index")]


@dataclass
class Page:
    """One page of a table query and, as its own one-row job, the full number of matches."""

    rows: DataFrame
    total: DataFrame


def query_table(rows: DataFrame, columns: list[tuple[str, str]], *, col: str | None = None, op: str = "contains",
                val: str | None = None, sort: str | None = None, dir: str = "asc", limit: int = 50, offset: int = 0) -> Page:
    """Filter, sort and page one table (row_index, cells). The page is a top-k, never a full sort."""
    kept = filter_rows(rows, columns, col, op, val)
    page = kept.orderBy(*sort_keys(columns, sort, dir)).offset(offset).limit(limit)
    return Page(page, kept.agg(F.count("*").alias("total")))


def list_tables(tables: DataFrame, documents: DataFrame) -> DataFrame:
    """Tables with their document's title and type, newest first."""
    return tables.join(documents.select("document_id", "title", "file_type"), "document_id").orderBy(F.desc("table_id"))


def load_table(table_rows: DataFrame, table_id: int) -> DataFrame:
    """Rows of one table in row order; the filter reaches the scan."""
    return table_rows.filter(F.col("table_id") == table_id).orderBy("row_index")


def any_cell_filter(table_rows: DataFrame, q: str, shown: int | None = None, numbered: bool = False) -> DataFrame:
    """Rows of every table with a cell containing the text (all rows for no text).

    All of them by default, where they lie; ``numbered`` adds ``shown_as``, their place in their table. With ``shown`` the
    first so many of each table, found before the shuffle, and ``left_out`` with the number of the others.
    """
    low = q.strip().lower()
    out = table_rows.filter(F.exists("cells", lambda c: F.lower(c).contains(low))) if low else table_rows
    if shown is None:
        return place_in_group(out, "table_id", "row_index", "shown_as") if numbered else out
    left_out = out.groupBy("table_id").agg(F.greatest(F.count("*") - shown, F.lit(0)).alias("left_out"))
    return top_k(out, "table_id", shown, [F.asc("row_index")], "shown_as").join(broadcast_if_small(left_out), "table_id")
