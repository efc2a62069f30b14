"""Rules that search less of a text or compute less of a row, against their plain form."""

from pyspark.sql import functions as F

from quirefold.functions import fixed_values as fv
from quirefold.operators import extract, tablefacts

TEXTS = ["a@b.co", "x\na@b.co c@d.org\ny z@\n@q.com\r\ne@f.net", "..@a.bc\n-@c.de,f@g.hi@j.kl", "no mark", "", None, "a@b.\nco m@n.op"]


def test_addresses_are_looked_for_in_lines_that_can_hold_them(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "document_id long, text string")
    plain = extract.rule_matches(F.col("text"), dict(fv.FIELD_RULES)["email"])
    want = docs.select("document_id", F.posexplode(plain).alias("pos", "value"))
    got = extract.extract_kind(docs, "email")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    kept = docs.select(extract._lines_with(F.col("text"), "@")).collect()
    assert kept[1][0] == "a@b.co c@d.org\ny z@\n@q.com\r\ne@f.net" and kept[3][0] == ""


def test_cells_are_made_once_per_row(spark):
    """The optimizer's size check below a plain explode made the cells of every row twice."""
    headers = spark.createDataFrame([(1, ["a", "b"]), (2, ["x", "y", "x"])], "table_id long, col_names array<string>")
    rows = spark.createDataFrame([(1, 0, ["p", "q", "r"]), (1, 1, ["s"]), (2, 0, ["1", "2", "3"]), (2, 1, [])], "table_id long, row_index int, cells array<string>")
    cells = extract.long_cells(tablefacts.last_of_name(extract.wide_rows(rows, headers)))
    got = sorted((r["table_id"], r["row_index"], r["col_index"], r["col_name"], r["value"]) for r in cells.collect())
    assert got == [
        (1, 0, 0, "a", "p"), (1, 0, 1, "b", "q"), (1, 1, 0, "a", "s"), (1, 1, 1, "b", ""),
        (2, 0, 0, "x", "3"), (2, 0, 1, "y", "2"), (2, 0, 2, "x", "3"), (2, 1, 0, "x", ""), (2, 1, 1, "y", ""), (2, 1, 2, "x", "")]
    assert cells._jdf.queryExecution().optimizedPlan().toString().count("arrays_zip") == 1
