"""Delimited text: delimiter vote, quoted cells, header inference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirefold.functions import fixed_values as fv
from quirefold.functions import text as tx
from quirefold.operators.extract import array_type
from quirefold.sources.parsed import block, failed, joined_rows, result

SAMPLE = 2048
_PREFERENCE = [",", "\t", ";", "|"]


_BREAK = fv.LINE_BREAK
_QUOTED = '"[^"]*+(?:""[^"]*+)*+'


def _escaped(delimiter: str) -> str:
    return "\\" + delimiter if delimiter == "|" else delimiter


def _sample(text: Column) -> Column:
    """Lines of the head of the text without what stands in quotes."""
    return tx.text_lines(F.regexp_replace(F.substring(text, 1, SAMPLE), '"[^"]*"', ""))


def delimiter_of(text: Column) -> Column:
    """The candidate that cuts most sample lines into the same number of cells; comma otherwise."""

    def votes(lines: Column, delimiter: str) -> Column:
        counts = F.filter(F.transform(lines, lambda ln: F.size(F.split(ln, _escaped(delimiter))) - 1), lambda n: n > 0)
        return tx.let(counts, lambda c: F.array_max(F.concat(
            F.array(F.lit(0)), F.transform(F.array_distinct(c), lambda v: F.size(F.filter(c, lambda w: w == v))))))

    def elect(lines: Column) -> Column:
        ranked = F.array(*[
            F.struct(votes(lines, d).alias("votes"), F.lit(-i).alias("order"), F.lit(d).alias("d"))
            for i, d in enumerate(_PREFERENCE)
        ])
        return F.array_max(ranked)["d"]

    return tx.let(_sample(text), elect)


def blanks_follow(text: Column, delimiter: Column) -> Column:
    """Whether every delimiter of the first line has a blank behind it, which then is no part of the cells."""
    count = lambda line, what: F.length(line) - F.length(F.replace(line, what, F.lit("")))
    return tx.let(F.coalesce(F.get(_sample(text), F.lit(0)), F.lit("")), lambda line: (
        (count(line, delimiter) > 0) & (count(line, delimiter) * 2 == count(line, F.concat(delimiter, F.lit(" "))))))


def cut_rows(text: Column, delimiter: Column, blanks: Column) -> Column:
    """Rows of cells. Quotes are read first, over the whole text: they protect delimiters and line ends, and doubled quotes
    stand for one. A line end within quotes is dropped; a quote that does not open a cell is an ordinary character."""
    d = F.when(delimiter == "|", "\\|").otherwise(delimiter)
    rest = F.concat(F.lit("[^"), d, F.lit(r"\x0a-\x0d\x1c-\x1e\x{85}\x{2028}\x{2029}]*+"))
    lead = F.when(blanks, " *+").otherwise("")
    cell = F.concat(lead, F.lit(f"(?:{_QUOTED}(?:\"|\\z)"), rest, F.lit("|"), rest, F.lit(")"))
    found = F.regexp_extract_all(F.concat(F.lit("\n"), text), F.concat(F.lit(f"(?:{_BREAK}|"), d, F.lit(")"), cell), F.lit(0))

    def value(match: Column) -> Column:
        bare = F.regexp_replace(match, F.concat(F.lit(f"^(?:{_BREAK}|"), d, F.lit(")"), lead), F.lit(""))
        inner = lambda c: tx.let(F.regexp_extract(c, f"^({_QUOTED})", 1), lambda q: F.replace(F.substring(q, F.lit(2), F.length(q)), F.lit('""'), F.lit('"')))
        opened = lambda c: F.concat(F.regexp_replace(inner(c), _BREAK, ""), F.regexp_replace(c, f'^{_QUOTED}"?', ""))
        return tx.let(bare, lambda c: F.when(c.startswith('"'), opened(c)).otherwise(c))

    def group(cells: Column) -> Column:
        heads = F.filter(F.transform(cells, lambda c, i: F.when(c.rlike(f"^(?:{_BREAK})"), i)), lambda i: i.isNotNull())
        return tx.let(heads, lambda hs: F.transform(hs, lambda at, k: F.transform(
            F.slice(cells, at + 1, F.coalesce(F.get(hs, k + 1), F.size(cells)) - at), value)))

    return tx.let(found, group)


def has_header(rows: Column) -> Column:
    """False only when typed columns exist and the first row has the type of every one of them."""

    def judge(rs: Column) -> Column:
        first = F.get(rs, F.lit(0))
        rest = F.slice(rs, F.lit(2), F.greatest(F.size(rs) - 1, F.lit(0)))
        width = F.array_max(F.transform(rs, F.size))
        per_column = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.struct(
            array_type(F.transform(rest, lambda r: F.coalesce(F.get(r, i), F.lit("")))).alias("below"),
            tx.strip(F.coalesce(F.get(first, i), F.lit(""))).alias("top"),
        ))
        typed = F.filter(per_column, lambda c: c["below"] != "text")
        return tx.let(typed, lambda t: F.when(F.size(t) == 0, True).otherwise(
            F.exists(t, lambda c: (c["top"] == "") | (array_type(F.array(c["top"])) != c["below"]))))

    return tx.let(rows, lambda rs: F.when(F.size(rs) < 2, True).otherwise(judge(rs)))


def rows_of(text: Column) -> Column:
    """Non-blank rows of cells."""
    parsed = tx.let(delimiter_of(text), lambda d: cut_rows(text, d, blanks_follow(text, d)))
    return F.filter(parsed, lambda r: F.exists(r, lambda c: tx.strip(c) != ""))


def parse_delimited(text: Column) -> Column:
    def build(s: Column) -> Column:
        rows, headed = s["rows"], s["headed"]
        auto = F.transform(F.sequence(F.lit(1), F.array_max(F.transform(rows, F.size))), lambda i: F.concat(F.lit("Column "), i.cast("string")))
        table = F.struct(
            F.lit("CSV").alias("name"),
            F.when(headed, F.get(rows, F.lit(0))).otherwise(auto).alias("columns"),
            F.when(headed, F.slice(rows, F.lit(2), F.size(rows))).otherwise(rows).alias("rows"),
            F.lit("rows").alias("location"),
        )
        warning = F.when(headed, F.array().cast("array<string>")).otherwise(
            F.array(F.lit(fv.NO_HEADER)))
        return result(F.array(block(joined_rows(rows, ","), "table", F.lit("rows"))), F.array(table), warning)

    def judge(rows: Column) -> Column:
        headed = tx.let(F.struct(rows.alias("rows"), has_header(rows).alias("headed")), build)
        return F.when(F.size(rows) == 0, failed("no rows")).otherwise(headed)

    return F.when(tx.strip(text) == "", failed(fv.EMPTY_FILE)).otherwise(tx.let(rows_of(text), judge))
