"""HTML pages: visible text as one prose block, every table as a grid. JVM expressions only.

Every table is a table of its own, however deep it is nested, and text of the cell that holds it.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirefold.functions import fixed_values as fv
from quirefold.functions import text as tx
from quirefold.sources.parsed import block, failed, joined_rows, result

# what may follow a tag's name; a quoted attribute value may hold a ">"
_REST = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>"""
TAG = rf"<[/!?a-zA-Z]{_REST}"
_JUNK = rf"(?is)<!--.*?-->|<(script|style|noscript)\b{_REST}.*?</\1\s*>"
_TITLE = rf"(?is)<title\b{_REST}(.*?)</title\s*>"
_ENTITY = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);"


# entity name -> character from the standard table of names, as one foldable expression
_NAMES = "\u0001".join(f"{name}\u0002{chr(code)}" for name, code in sorted(name2codepoint.items()))


def _named() -> Column:
    return F.str_to_map(F.lit(_NAMES), F.lit("\u0001"), F.lit("\u0002"))


def _character(entity: Column) -> Column:
    """The character an entity body stands for, or null."""
    numeric = entity.startswith("#")
    hexed = F.lower(F.substring(entity, 2, 1)) == "x"
    digits = F.when(hexed, F.lpad(F.substring(entity, F.lit(3), F.length(entity)), 8, "0")).otherwise(
        F.lpad(F.hex(F.substring(entity, F.lit(2), F.length(entity)).try_cast("long")), 8, "0"))
    return F.when(numeric, F.decode(F.unhex(digits), "UTF-32")).otherwise(F.try_element_at(_named(), entity))


def unescape(text: Column) -> Column:
    """Entities as characters; the ampersand is restored last so nothing is decoded twice."""

    def decode(t: Column) -> Column:
        bodies = F.array_distinct(F.regexp_extract_all(t, F.lit(_ENTITY), F.lit(1)))
        known = F.filter(F.transform(bodies, lambda e: F.struct(_character(e).alias("c"), e.alias("e"))), lambda p: p["c"].isNotNull())
        ordered = F.array_sort(F.transform(known, lambda p: F.struct((p["c"] == "&").alias("last"), p["e"].alias("e"), p["c"].alias("c"))))
        decoded = F.aggregate(ordered, t, lambda acc, p: F.replace(acc, F.concat(F.lit("&"), p["e"], F.lit(";")), p["c"]))
        return F.when(t.contains("&"), decoded).otherwise(t)

    return tx.let(text, decode)


def without_tags(html: Column) -> Column:
    return F.regexp_replace(html, TAG, "")


def split_tables(html: Column) -> Column:
    """struct(outside, tables): the text around all tables, and every table in document order, in which nested
    tables are reduced to their text. A table that is never closed ends with the page.

    The page is cut before each start and after each end of a table. One walk over the cuts, which carries numbers
    only, gives every piece its depth and every table its first and last piece.
    """
    pieces = F.split(html, r"(?i)(?=<table\b)|(?<=</table\s{0,9}>)", -1)
    ints, spans = "array<int>", "array<struct<first:int,last:int>>"
    start = F.struct(F.array().cast(ints).alias("open"), F.array().cast(ints).alias("depths"), F.array().cast(spans).alias("tables"))

    def step(acc: Column, piece: Column) -> Column:
        at = F.size(acc["depths"])
        opened = F.when(piece.rlike(r"(?i)^<table\b"), F.concat(acc["open"], F.array(at))).otherwise(acc["open"])

        def close(now: Column) -> Column:
            ends = piece.rlike(r"(?i)</table\s{0,9}>\z") & (F.size(now) > 0)
            span = F.struct(F.get(now, F.size(now) - 1).alias("first"), at.alias("last"))
            return F.struct(
                F.when(ends, F.slice(now, F.lit(1), F.size(now) - 1)).otherwise(now).alias("open"),
                F.concat(acc["depths"], F.array(F.size(now))).alias("depths"),
                F.when(ends, F.concat(acc["tables"], F.array(span))).otherwise(acc["tables"]).alias("tables"))

        return tx.let(opened, close)

    def build(s: Column) -> Column:
        ps, w = s["pieces"], s["walk"]
        unclosed = F.transform(w["open"], lambda i: F.struct(i.alias("first"), (F.size(ps) - 1).alias("last")))
        own = lambda t: F.array_join(F.transform(
            F.slice(F.arrays_zip(ps.alias("p"), w["depths"].alias("d")), t["first"] + 1, t["last"] - t["first"] + 1),
            lambda x: F.when(x["d"] == F.get(w["depths"], t["first"]), x["p"]).otherwise(without_tags(x["p"]))), "")
        outside = F.filter(F.transform(ps, lambda p, i: F.when(F.get(w["depths"], i) == 0, p)), lambda p: p.isNotNull())
        return F.struct(
            F.array_join(outside, "").alias("outside"),
            F.transform(F.array_sort(F.concat(w["tables"], unclosed)), own).alias("tables"))

    walked = tx.let(pieces, lambda ps: F.struct(ps.alias("pieces"), F.aggregate(ps, start, step).alias("walk")))
    return tx.let(walked, build)


def grid(flat: Column) -> Column:
    """Rows of cells of one table without nested tables: blank rows dropped, short rows padded."""
    parts = lambda s, tag: F.slice(F.split(s, rf"(?i)<{tag}\b{_REST}"), F.lit(2), F.lit(1 << 30))
    cell = lambda c: F.array_join(tx.words(unescape(without_tags(F.regexp_replace(c, r"(?is)</t[dh]\b.*", "")))), " ")
    rows = F.transform(parts(flat, "tr"), lambda r: F.transform(parts(F.regexp_replace(r, r"(?is)</tr\b.*", ""), "t[dh]"), cell))
    kept = F.filter(rows, lambda r: F.exists(r, lambda c: c != ""))
    return tx.let(kept, lambda k: tx.let(
        F.array_max(F.transform(k, F.size)),
        lambda w: F.transform(k, lambda r: F.concat(r, F.array_repeat(F.lit(""), w - F.size(r)))),
    ))


def table_grids(tables: Column) -> Column:
    """Grids of the tables of ``split_tables``; a nested table follows the one that holds it."""
    return F.transform(tables, grid)


def visible_text(outside: Column) -> Column:
    """Text without tags, entities decoded, one stripped non-blank line per line."""
    lines = F.transform(tx.text_lines(unescape(without_tags(outside))), tx.strip)
    return F.array_join(F.filter(lines, lambda ln: ln != ""), "\n")


def page_title(clean: Column) -> Column:
    raw = F.when(clean.rlike(r"(?i)<title\b"), F.regexp_extract(clean, _TITLE, 1))
    return tx.let(raw, lambda r: F.when(r != "", tx.strip(unescape(r))))


def clean_html(html: Column) -> Column:
    return F.regexp_replace(html, _JUNK, "")


def parse_html(html: Column) -> Column:
    def build(s: Column) -> Column:
        title, text = s["title"], s["text"]
        numbered = F.filter(
            F.transform(s["grids"], lambda g, i: F.struct(g.alias("grid"), F.concat(F.lit("table "), (i + 1).cast("string")).alias("location"), (i + 1).alias("n"))),
            lambda t: F.size(t["grid"]) > 0,
        )
        tables = F.transform(numbered, lambda t: F.struct(
            F.when(title != "", title).otherwise(F.concat(F.lit("Table "), t["n"].cast("string"))).alias("name"),
            F.get(t["grid"], F.lit(0)).alias("columns"),
            F.slice(t["grid"], F.lit(2), F.size(t["grid"])).alias("rows"),
            t["location"].alias("location"),
        ))
        blocks = F.transform(numbered, lambda t: block(joined_rows(t["grid"], "\t"), "table", t["location"]))
        prose = F.filter(F.array(block(text, "prose", F.lit("body"), title)), lambda b: b["text"] != "")
        parsed = F.struct(F.concat(prose, blocks).alias("blocks"), tables.alias("tables"))
        return tx.let(parsed, lambda p: F.when(F.size(p["blocks"]) == 0, failed(fv.NO_TEXT)).otherwise(result(p["blocks"], p["tables"])))

    cut = lambda c: tx.let(split_tables(c), lambda s: F.struct(
        page_title(c).alias("title"), visible_text(s["outside"]).alias("text"), table_grids(s["tables"]).alias("grids")))
    whole = tx.let(clean_html(html), lambda c: tx.let(cut(c), build))
    return F.when(tx.strip(html) == "", failed(fv.EMPTY_FILE)).otherwise(whole)
