"""Field rules: their fast forms against the plain patterns, and their cost on long texts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quirefold.functions import fixed_values as fv
from quirefold.functions import text as tx
from quirefold.operators import extract

PIECES = [
    "a", "B", "x", "X9", " ", "  ", "\t", "\n", "\r\n", "\r", "\x0b", "\x1c", "\x85", " ", "\xa0", ":", "::", ":=", "//", "http://a.b", "mailto", "Rs", "Rs.",
    "₹", "€", "USD 5", "12", "1,234.56", "2024-01-02", "3/4/21", "Jan 5, 2023", "+91 90000 00001", "9000000000", "é", "ſ", "K", "İ", "ı",
    "graph", "Flowchart LR", "note over", "claſsDef", "linK", "```", "-->", "==>", "|>", "~~~", "→", "a@b.co", "x.y%z@q.org.", "@", "a@b.com%x@y.net", ".", "-",
    "_", "Total: 55", "name", "item x2 Rs.5", " ×3 ₹5", "{}", "<b>", "`", "&&", "!", "日本", "😀", "٣",
]


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(11)
    line = lambda: "".join(r.choice(PIECES) for _ in range(r.randint(0, 8)))
    rows = [(i, "\n".join(line() for _ in range(r.randint(1, 5)))) for i in range(4000)] + [(4000, None), (4001, "")]
    return spark.createDataFrame(rows, "document_id long, text string").repartition(4)


def differ(df, left, right):
    return df.select("text", left.alias("l"), right.alias("r")).filter(~F.col("l").eqNullSafe(F.col("r"))).limit(3).collect()


def test_rules_find_what_their_patterns_find(odd):
    for kind, pattern in fv.FIELD_RULES:
        plain = F.filter(F.transform(extract.rule_matches(F.col("text"), pattern), tx.strip), lambda v: v != "")
        assert not differ(odd.filter("text is not null"), F.transform(extract.typed_matches(F.col("text"), kind, pattern), lambda f: f["value"]), plain)


def test_plain_texts_are_their_own_source_of_pairs(odd):
    pairs = lambda source: F.regexp_extract_all(source, F.lit("(?dmU)" + fv.PAIR_PATTERN), F.lit(0))
    assert not differ(odd, pairs(extract.pair_source(F.col("text"))), pairs(extract._pair_lines(F.col("text"))))
    plain = odd.filter(extract._plain(F.col("text"))).count()
    assert 0 < plain < odd.count()


def test_first_of_each_keeps_order(spark):
    rows = [(1, [("k", "b", "pair"), ("K", "B", "pair"), ("k", "a", "pair")]), (2, [("k", "b", "pair"), ("k", "a", "pair")]), (3, [])]
    df = spark.createDataFrame(rows, "i int, f array<struct<key:string,value:string,kind:string>>")
    got = {r["i"]: [tuple(f) for f in r["o"]] for r in df.select("i", extract.first_of_each(F.col("f")).alias("o")).collect()}
    assert got == {1: [("k", "b", "pair"), ("k", "a", "pair")], 2: [("k", "b", "pair"), ("k", "a", "pair")], 3: []}


def test_a_long_run_of_letters_is_read_once_for_addresses(spark):
    df = spark.range(1).select(F.concat(F.repeat(F.lit("a"), 400_000), F.lit(" x@y.org")).alias("t"))
    start = time.time()
    found = df.select(extract.typed_matches(F.col("t"), "email", dict(fv.FIELD_RULES)["email"]).alias("m")).first()["m"]
    assert [f["value"] for f in found] == ["x@y.org"] and time.time() - start < 20
