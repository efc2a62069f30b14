"""Field extraction and column typing.

A document is one row, so every rule, the ordered de-duplication, the suppression of
pairs that repeat a typed value and the per-document cap are array expressions over that
row: no shuffle, no Python, one pass over the text.
"""

from __future__ import annotations

from string import ascii_letters, digits

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions import fixed_values as fv
from quirefold.functions import text as tx
from quirefold.functions.ids import child_id

_UNICODE = "(?dU)"
_FIELD = "array<struct<key:string,value:string,kind:string>>"


def rule_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(_UNICODE + pattern), F.lit(group))


# text every match of a rule must hold; a plain search skips the pattern on most texts
_MARKS = {"email": "@", "url": "://"}
_NONE = "array<string>"
# rules whose matches never leave a line: only lines with the mark are searched
_IN_LINES = {"email"}


def _lines_with(text: Column, mark: str) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: line.contains(mark)), "\n")


# The characters a match of a rule can begin with, as a look-ahead: elsewhere a text costs one test per letter. An address can
# only begin where a run of its letters begins or where the last one ended; said so, a long run is read once.
# Letters are listed one by one where a class is tested often: Java looks those up in a table, but walks through ranges.
_ALNUM = ascii_letters + digits
_EMAIL_LETTER = rf"[{_ALNUM}._%+\-]"
_BEGINS = {"email": rf"(?:\G|(?<!{_EMAIL_LETTER}))", "amount": r"(?=[₹$€£RIUE])", "date": r"(?=[\dJFMASOND])", "phone": r"(?=[+\d])"}


def typed_matches(text: Column, kind: str, pattern: str) -> Column:
    """Stripped, non-empty matches of one typed rule as (key, value, kind), in text order."""
    fixed = dict(fv.FIELD_RULES).get(kind) == pattern
    whole, text = text, _lines_with(text, _MARKS[kind]) if fixed and kind in _IN_LINES else text
    found = rule_matches(text, f"{_BEGINS[kind]}(?:{pattern})" if fixed and kind in _BEGINS else pattern)
    if fixed and kind in _MARKS:
        found = F.when(whole.contains(_MARKS[kind]), found).otherwise(F.array().cast(_NONE))
    values = F.filter(F.transform(found, tx.strip), lambda v: v != "")
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("key"), v.alias("value"), F.lit(kind).alias("kind")))


# A name is a stretch of these characters, so it can only begin where such a run begins or
# where the last item ended. Saying so keeps the search linear in the text.
_ITEM_START = rf"(?:\G|(?<![{_ALNUM} \-]))[{digits} \-]*+"


# the letters of a name are no space: one test of them goes before the costlier one for any space
_ITEM = fv.LINE_ITEM_PATTERN.replace(r"[A-Za-z0-9 \-]*?)\s+[x×]", rf"[{_ALNUM} \-]*?)(?![{_ALNUM}\-])\s+[x×]")


def item_matches(text: Column) -> Column:
    """Line items: name, quantity marker and price, as (name, "×quantity · price", item)."""
    pattern = _UNICODE + fv.LINE_ITEM_PATTERN
    return F.transform(
        rule_matches(text, f"{_ITEM_START}({_ITEM})", 1),
        lambda m: F.struct(
            tx.strip(F.regexp_extract(m, pattern, 1)).alias("key"),
            F.concat(F.lit("×"), F.regexp_extract(m, pattern, 2), F.lit(" · "), F.regexp_extract(m, pattern, 3)).alias("value"),
            F.lit("item").alias("kind"),
        ),
    )


# A text without any of these has no fence, no arrow, no line of a diagram and no line end but "\n": all its lines can hold
# pairs. The letters are line ends, arrows and those that equal an ASCII one if case is ignored.
_ODD_LETTERS = r"[\x0b\x0c\r\x1c\x1d\x1e]"
_ODD_WIDE_LETTERS = r"[\x{85}\x{2028}\x{2029}→←⟶\x{17f}\x{212a}\x{130}\x{131}]"
_NOT_PLAIN_MARKS = ["```", "-->", "-.->", "==>", "|>", "--|", "~~~"]
_DIAGRAM_MARKS = ["graph", "flowchart", "diagram", "gantt", "style", "class", "participant", "actor", "note "]


def _plain(text: Column) -> Column:
    ascii_only = F.octet_length(text) == F.length(text)
    return (
        ~tx.contains_any(text, _NOT_PLAIN_MARKS) & ~text.rlike(_ODD_LETTERS) & (ascii_only | ~text.rlike(_ODD_WIDE_LETTERS))
        & tx.let(F.lower(text), lambda low: ~tx.contains_any(low, _DIAGRAM_MARKS))
    )


def pair_source(text: Column) -> Column:
    """Lines that can hold a pair: outside fenced code, with a colon, no diagram or arrow line.

    A plain text is its own source, as a match needs a colon and never leaves its line.
    """
    return F.when(_plain(text), text).otherwise(_pair_lines(text))


def _pair_lines(text: Column) -> Column:
    unfenced = F.when(text.contains("```"), F.regexp_replace(text, "(?s)" + fv.FENCE_PATTERN, " ")).otherwise(text)
    kept = F.filter(
        tx.text_lines(unfenced),
        lambda ln: ln.contains(":") & ~ln.rlike("(?iU)" + fv.DIAGRAM_LINE_PATTERN) & ~ln.rlike(fv.ARROW_LINE_PATTERN),
    )
    return F.array_join(kept, "\n")


# noise by its first letters, and values of which at least every second letter is readable without counting
_NOISE = rf"(?=[|<>{{}}\[\]`\-=:&])(?:{fv.PAIR_NOISE_PATTERN})"
_READABLE = rf"\A(?:[^{_ALNUM} ]?+[{_ALNUM} ])++\z"


def readable_pair(key: Column, value: Column) -> Column:
    """False for code-like or mostly-punctuation keys and values."""
    readable = F.length(F.regexp_replace(value, r"[^\p{L}\p{N}\s\x{85}\x{a0}]", ""))
    return (
        value.rlike("[A-Za-z0-9]")
        & ~F.concat_ws("\n", key, value).rlike(_NOISE)
        & (value.rlike(_READABLE) | (readable >= F.length(value) * fv.PAIR_READABLE_SHARE))
    )


def raw_pairs(text: Column) -> Column:
    """Label/value pairs of the lines that are neither code nor diagrams, before any guard.

    A label begins with a letter and can end in spaces only; a value has no blanks around it unless it is one blank.
    """
    pattern = F.lit("(?dmU)" + fv.PAIR_PATTERN)
    return tx.let(pair_source(text), lambda s: F.zip_with(
        F.regexp_extract_all(s, pattern, F.lit(1)), F.regexp_extract_all(s, pattern, F.lit(2)),
        lambda k, v: F.struct(F.rtrim(k).alias("key"), F.when(v.isin(" ", "\t"), "").otherwise(v).alias("value"))))


def pair_matches(text: Column, typed_values: Column) -> Column:
    """Guarded pairs whose value is not already one of ``typed_values`` (lower case)."""
    pairs = F.transform(
        F.filter(raw_pairs(text), lambda p: (F.length(p["value"]) <= fv.PAIR_VALUE_MAX) & ~p["value"].startswith("//")),
        lambda p: F.struct(p["key"].alias("key"), tx.strip(p["value"]).alias("value"), F.lit("pair").alias("kind")),
    )
    return F.filter(
        pairs,
        lambda p: ~F.array_contains(tx.literal_strings(fv.URL_SCHEMES), F.lower(p["key"]))
        & ~F.array_contains(typed_values, F.lower(p["value"]))
        & readable_pair(p["key"], p["value"]),
    )


def _signature(f: Column) -> Column:
    """Named fields are unique per label and value, typed fields per value."""
    named = f["kind"].isin("pair", "item")
    return F.concat_ws("\u0001", f["kind"], F.when(named, F.lower(f["key"])).otherwise(""), F.lower(f["value"]))


def first_of_each(fields: Column) -> Column:
    """First field of every signature, in order. Fields that all differ are told by a set of signatures and stay as they are."""
    return tx.let(fields, lambda f: F.when(
        F.size(F.array_distinct(F.transform(f, _signature))) == F.size(f), f).otherwise(_first_by_sorting(f)))


def _first_by_sorting(fields: Column) -> Column:
    """By sorting, so that documents with very many fields stay cheap."""
    tagged = F.transform(fields, lambda f, i: F.struct(_signature(f).alias("s"), i.alias("i"), f.alias("f")))
    first = lambda t: F.filter(t, lambda x, i: F.coalesce(F.get(t, i - 1)["s"] != x["s"], F.lit(True)))
    in_order = F.array_sort(F.transform(tx.let(F.array_sort(tagged), first), lambda x: F.struct(x["i"].alias("i"), x["f"].alias("f"))))
    return F.transform(in_order, lambda x: x["f"])


def with_fields(docs: DataFrame, text_col: str = "text", rules=None, limit: int | None = None) -> DataFrame:
    """Add ``fields``: the ordered, de-duplicated fields of every document row.

    All of them by default; with a ``limit`` the first so many, and ``fields_left_out`` with the number of the others.
    """
    rules = fv.FIELD_RULES if rules is None else rules
    text = F.col(text_col)
    typed = F.concat(F.array().cast(_FIELD), *[typed_matches(text, k, p) for k, p in rules])

    def rest(first: Column) -> Column:
        seen = F.transform(first, lambda f: F.lower(f["value"]))
        named = tx.let(seen, lambda s: F.concat(item_matches(text), pair_matches(text, s)))
        return F.concat(first, first_of_each(named))

    found = docs.withColumn("fields", tx.let(first_of_each(typed), rest))
    if limit is None:
        return found
    left_out = F.greatest(F.size("fields") - limit, F.lit(0))
    return found.withColumn("fields_left_out", left_out).withColumn("fields", F.slice("fields", 1, limit))


def explode_fields(docs: DataFrame) -> DataFrame:
    """(field_id, document_id, key, value, kind) from rows that carry ``fields``."""
    return tx.numbered(docs, ["document_id"], F.col("fields"), "pos", "f").select(
        child_id(F.col("document_id"), F.col("pos")).alias("field_id"),
        "document_id", F.col("f.key").alias("key"), F.col("f.value").alias("value"), F.col("f.kind").alias("kind"),
    )


def extract_fields(docs: DataFrame, text_col: str = "text", rules=None, limit: int | None = None) -> DataFrame:
    return explode_fields(with_fields(docs.select("document_id", text_col), text_col, rules, limit))


def extract_kind(docs: DataFrame, kind: str, text_col: str = "text") -> DataFrame:
    """Every match of one typed rule (document_id, pos, value), before de-duplication."""
    pattern = dict(fv.FIELD_RULES)[kind]
    return tx.numbered(docs, ["document_id"], typed_matches(F.col(text_col), kind, pattern), "pos", "f").select(
        "document_id", "pos", F.col("f.value").alias("value")
    )


# --- column typing -------------------------------------------------------------------------

def is_number_cell(cell: Column) -> Column:
    return F.regexp_replace(cell, " ", "").rlike("(?U)" + fv.NUMERIC_CELL_PATTERN)


def has_date(cell: Column) -> Column:
    return cell.rlike(_UNICODE + fv.DATE_PATTERN)


def type_of(numeric: Column, dated: Column, filled: Column) -> Column:
    """Type from the number of numeric, dated and non-blank cells."""
    return F.when(filled == 0, "text").when(numeric == filled, "number").when(dated == filled, "date").otherwise("text")


def array_type(values: Column) -> Column:
    """Type of a column given as an array of cells."""
    cells = F.filter(F.transform(values, lambda v: tx.strip(F.coalesce(v, F.lit("")))), lambda v: v != "")
    return type_of(F.size(F.filter(cells, is_number_cell)), F.size(F.filter(cells, has_date)), F.size(cells))


def wide_rows(table_rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows with their header (table_id, row_index, cells, col_names).

    Short rows read as "" in the missing columns, long rows are cut to the header.
    """
    from quirefold.session import broadcast_if_small

    joined = table_rows.join(broadcast_if_small(headers.select("table_id", "col_names")), "table_id")
    padded = F.transform("col_names", lambda _, i: F.coalesce(F.get("cells", i), F.lit("")))
    return joined.select("table_id", "row_index", padded.alias("cells"), "col_names")


def long_cells(wide: DataFrame) -> DataFrame:
    """(table_id, row_index, col_index, col_name, value) from wide rows."""
    return tx.numbered(wide, ["table_id", "row_index"], F.arrays_zip("col_names", "cells"), "col_index", "c").select(
        "table_id", "row_index", "col_index", F.col("c.col_names").alias("col_name"), F.col("c.cells").alias("value"))


def cells_of(table_rows: DataFrame, headers: DataFrame) -> DataFrame:
    return long_cells(wide_rows(table_rows, headers))


def infer_types(cells: DataFrame) -> DataFrame:
    """(table_id, col_index, col_name, type): counts are partially aggregated before the shuffle."""
    v = tx.strip(F.col("value"))
    filled = v != ""
    return (
        cells.groupBy("table_id", "col_index", "col_name")
        .agg(
            F.count_if(filled & is_number_cell(v)).alias("n_num"),
            F.count_if(filled & has_date(v)).alias("n_date"),
            F.count_if(filled).alias("n"),
        )
        .select("table_id", "col_index", "col_name", type_of(F.col("n_num"), F.col("n_date"), F.col("n")).alias("type"))
    )


def build_tables(table_rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Headers with typed column definitions and row counts: one row per table."""
    defs = (
        infer_types(cells_of(table_rows, headers))
        .groupBy("table_id")
        .agg(F.array_sort(F.collect_list(F.struct("col_index", F.col("col_name").alias("name"), "type"))).alias("c"))
        .select("table_id", F.transform("c", lambda c: F.struct(c["name"].alias("name"), c["type"].alias("type"))).alias("columns"))
    )
    counts = table_rows.groupBy("table_id").agg(F.count("*").alias("row_count"))
    return (
        headers.join(defs, "table_id", "left").join(counts, "table_id", "left")
        .withColumn("row_count", F.coalesce("row_count", F.lit(0)))
        .withColumn(
            "columns",
            F.coalesce("columns", F.transform("col_names", lambda n: F.struct(n.alias("name"), F.lit("text").alias("type")))),
        )
    )


def typed_frame(table_rows: DataFrame, columns: list[tuple[str, str]], table_id: int) -> DataFrame:
    """One extracted table as a DataFrame with a double, text or date-text column per definition."""
    out = [F.col("row_index")]
    for i, (name, kind) in enumerate(columns):
        cell = F.coalesce(F.get("cells", F.lit(i)), F.lit(""))
        out.append((tx.coerce_number(cell) if kind == "number" else cell).alias(name))
    return table_rows.filter(F.col("table_id") == table_id).select(*out)
