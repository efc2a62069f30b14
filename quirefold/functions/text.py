"""Column functions over text. Everything here stays in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirefold.functions import fixed_values as fv

SPACES = fv.SPACE_CLASS + "+"
WORD = r"[\p{L}\p{N}_]"


def _accent_table() -> tuple[str, str]:
    """Letter -> base letter for every canonical decomposition into a letter and marks."""
    src, dst = [], []
    for code in range(0xC0, 0x10000):
        ch = chr(code)
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) > 1 and all(unicodedata.category(p) == "Mn" for p in parts[1:]):
            src.append(ch)
            dst.append(parts[0])
    return "".join(src), "".join(dst)


_ACCENTED, _PLAIN = _accent_table()


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body``.

    Expressions inside array lambdas are not shared by the optimizer; a lambda variable is.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def numbered(df, columns, array, pos: str, item: str):
    """``columns`` and one row per element of ``array`` with its position.

    The optimizer puts a size check of the array below a plain explode and so computes a costly
    array again for the check; the outer form has no such check, and empty arrays are dropped here.
    """
    return df.select(*columns, F.posexplode_outer(array).alias(pos, item)).filter(F.col(pos).isNotNull())


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(fv.SPACE_CHARACTERS))


def words(c: Column) -> Column:
    return F.filter(F.split(c, SPACES), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def estimate_tokens(n_words: Column) -> Column:
    """Whole-number form of 1.6 tokens per word, plus one."""
    return F.floor(n_words * 8 / 5).cast("int") + 1


def token_estimate(c: Column) -> Column:
    return estimate_tokens(word_count(c))


def text_lines(c: Column) -> Column:
    """Lines without their line ends; a trailing line end opens no empty last line."""
    return let(
        F.split(c, fv.LINE_BREAK),
        lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p),
    )


def fold(c: Column) -> Column:
    """Lower case, no combining marks, accented letters reduced to their base letter."""
    return F.translate(F.regexp_replace(F.lower(c), r"\p{Mn}", ""), _ACCENTED, _PLAIN)


def tokens(c: Column) -> Column:
    return F.filter(F.split(fold(c), fv.NON_TOKEN), lambda t: t != "")


def word_terms(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD}+)"), F.lit(1))


def ascii_terms(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))


def literal_strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def contains_any(c: Column, cues: list[str]) -> Column:
    """True when any cue is a substring of ``c``; one pass per cue, no join."""
    found = F.lit(False)
    for cue in cues:
        found = found | c.contains(cue)
    return found


def padded_lower(c: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(c), F.lit(" "))


def content_terms(q: Column) -> Column:
    """Distinct non-stopword terms of two letters or more, longest first, then by letter."""
    kept = F.filter(
        word_terms(q),
        lambda t: (F.length(t) > 1) & ~F.array_contains(literal_strings(fv.STOPWORDS), t),
    )
    ordered = F.array_sort(F.transform(F.array_distinct(kept), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return F.transform(ordered, lambda s: s["t"])


def snippet(text: Column, terms: Column, width: int = fv.SNIPPET_WIDTH) -> Column:
    """A window around the first listed term that occurs, a third of it before the term."""

    def window(start: Column) -> Column:
        return F.concat(
            F.when(start > 0, "…").otherwise(""),
            strip(F.substring(text, start + 1, F.lit(width))),
            F.when(start + width < F.length(text), "…").otherwise(""),
        )

    places = let(F.lower(text), lambda low: F.transform(terms, lambda t: F.call_function("instr", low, t)))
    first = F.get(F.filter(places, lambda p: p > 0), F.lit(0))
    return let(F.greatest(F.coalesce(first, F.lit(1)) - 1 - width // 3, F.lit(0)), window)


def highlight(text: Column, q: Column) -> Column:
    """Wrap every non-stopword query word in <mark> tags, ignoring case."""
    kept = F.filter(
        F.split(F.lower(q), SPACES),
        lambda t: (F.length(t) > 1) & ~F.array_contains(literal_strings(fv.HIGHLIGHT_STOPWORDS), t),
    )
    escaped = F.array_join(F.transform(kept, lambda t: F.regexp_replace(t, r"([.*+?^${}()|\[\]\\])", r"\\$1")), "|")
    return let(
        escaped,
        lambda e: F.when(e == "", text).otherwise(
            F.regexp_replace(text, F.concat(F.lit("(?iu)("), e, F.lit(")")), F.lit("<mark>$1</mark>"))
        ),
    )


_FLOAT_SHAPE = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)$"


def coerce_number(c: Column) -> Column:
    """Whole-cell number: thousands commas and trailing percent signs dropped, else null."""
    bare = strip(F.regexp_replace(F.regexp_replace(c, ",", ""), r"%+\z", ""))
    joined = F.regexp_replace(bare, r"(?<=\d)_(?=\d)", "")
    return F.when(joined.rlike(_FLOAT_SHAPE), joined.try_cast("double"))


def parse_number(c: Column) -> Column:
    """First signed decimal inside the text after dropping commas, else null."""
    hit = F.regexp_extract(F.regexp_replace(c, ",", ""), r"-?\d+(?:\.\d+)?", 0)
    return F.when(hit != "", hit.try_cast("double"))


def round_cents(x: Column) -> Column:
    """An amount to two places, decided on the binary value as it is, a true tie to the even cent.

    The fraction is cut into two halves whose products with 1000 are exact, so no rounding of its own enters.
    """
    whole = F.floor(x)
    frac = x - whole
    high = F.floor(frac * float(1 << 26)) / float(1 << 26)
    cents = F.floor(frac * 100)
    rest, tie = (frac - high) * 1000, cents * 10 + 5 - high * 1000
    up = (rest > tie) | ((rest == tie) & (cents % 2 == 1))
    return (whole * 100 + cents + F.when(up, 1).otherwise(0)) / F.lit(100.0)


def display_number(x: Column) -> Column:
    """Thousands separators; no decimals for whole values, otherwise two."""
    return F.when(F.abs(x - F.rint(x)) < 1e-9, F.format_number(x, 0)).otherwise(F.format_number(x, 2))
