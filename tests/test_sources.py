"""Formats: text sections, delimited files, JSON and HTML."""

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from quirefold.functions import fixed_values as fv
from quirefold.operators import ingest
from quirefold.sources import delimited, files


def parse(spark, tmp_path, contents):
    """Write the named contents as files and return {filename: parsed row}."""
    for name, body in contents.items():
        (tmp_path / name).write_bytes(body if isinstance(body, bytes) else body.encode())
    docs = files.scan_files(spark, str(tmp_path)).withColumn("document_id", F.hash("filename").cast("long"))
    return {r["filename"]: r for r in files.parse(docs).collect()}


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    return parse(spark, tmp_path_factory.mktemp("docs"), {
        "hello.txt": "hello world this is a note about payments",
        "notes.md": "# Title\n\nSome **markdown** about bills.\n## Empty\n## Next\nlast\r\nline",
        "only.md": "# A\n# B",
        "blank.txt": b"   ",
        "bad.txt": b"caf\xff\xfe ok",
        "wide.csv": "stop;km;line\nHarbour;1204.75;T-01\nMill;88.50;T-02\n",
        "nohead.csv": "Orchard,19.99,2031-04-05\nQuarry,7.25,2031-05-06\nTannery,1.00,2031-06-07\n",
        "semi.csv": 'town;motto\nUlm;"p; ""q"""\n;\nBern;r\n',
        "bom.csv": b"\xef\xbb\xbfleft,right\nu,8\nv,9\n",
        "lines.csv": 'id, remark, seen\r\n1, "first line\r\nsecond, with comma", 2030-01-01\r\n2, "say ""no""", 2030-01-02',
        "a.json": json.dumps([{"ship": "Vega", "tons": 10}, {"ship": "Lyra", "port": None, "afloat": True}]),
        "o.json": json.dumps({"voyage": "V-9", "days": 12.5, "master": {"name": "R. Holm"}, "ports": ["Oslo", "Kiel"],
                              "mixed": [1, {"k": "v"}, [2, 3]], "none": None, "legs": [{"no": 1, "at": {"sea": "North"}}]}),
        "bad.json": "[1, 2",
        "e.json": "  ",
        "a.html": "<html><head><title>Report &amp; Q1</title><style>.x{color:red}</style></head><body><h1>Revenue</h1>\n"
                  "<p>Strong &lt;quarter&gt; &amp;lt; caf&eacute; &#233;&#xe9;.</p><script>steal()</script><!-- no --></body></html>",
        "t.html": "<table><tr><th>Tree</th><th>Age</th></tr><tr><td>Oak</td><td> 90 \n y</td></tr><tr><td>Ash</td></tr><tr><td> </td></tr></table>",
        "n.html": "<table><tr><td>Outer<table><tr><td>in<TABLE><tr><td>deep<table><tr><td title='x > y'>deepest</td></tr></table ></td></tr></table></td>"
                  "<td>side</td></tr></table></td><td>end</td></tr></table>",
        "q.html": '<p title="a > b" data-x=\'c > d\'>hi</p>\n<p class=its>there</p>',
        "e.html": " ",
        "x.exe": "MZ",
    })


def texts(row):
    return [b["text"] for b in row["blocks"]]


def test_text_and_headings(parsed):
    assert texts(parsed["hello.txt"]) == ["hello world this is a note about payments"]
    md = parsed["notes.md"]["blocks"]
    assert [(b["heading"], b["text"]) for b in md] == [("Title", "Some **markdown** about bills."), ("Next", "last\nline")]
    assert texts(parsed["only.md"]) == ["# A\n# B"]
    assert parsed["blank.txt"]["error"] == "file is empty"
    assert texts(parsed["bad.txt"]) == ["caf\ufffd\ufffd ok"]


def test_delimited(parsed):
    t = parsed["wide.csv"]["tables"][0]
    assert t["columns"] == ["stop", "km", "line"] and t["rows"] == [["Harbour", "1204.75", "T-01"], ["Mill", "88.50", "T-02"]]
    t = parsed["nohead.csv"]["tables"][0]
    assert t["columns"] == ["Column 1", "Column 2", "Column 3"] and t["rows"][0] == ["Orchard", "19.99", "2031-04-05"] and len(t["rows"]) == 3
    assert parsed["nohead.csv"]["warnings"] == [fv.NO_HEADER]
    t = parsed["semi.csv"]["tables"][0]
    assert t["columns"] == ["town", "motto"] and t["rows"] == [["Ulm", 'p; "q"'], ["Bern", "r"]]
    assert parsed["bom.csv"]["tables"][0]["columns"] == ["left", "right"]
    block = parsed["wide.csv"]["blocks"][0]
    assert (block["kind"], block["location"]) == ("table", "rows")
    t = parsed["lines.csv"]["tables"][0]
    assert t["columns"] == ["id", "remark", "seen"]
    assert t["rows"] == [["1", "first linesecond, with comma", "2030-01-01"], ["2", 'say "no"', "2030-01-02"]]


def test_rows_are_those_of_the_standard_reader(spark):
    rng = random.Random(1)
    cases = []
    for _ in range(400):
        d, blank = rng.choice(",;|\t"), rng.random() < 0.4
        parts = ["a", "b", '"', '""', "\n", "\r\n", d, d + " ", " ", "x y", f'"q{d}"', '"m\nn"', d + (" " if blank else "") + f'"z{d}w"']
        cases.append(("".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))), d, blank))
    cases += [('"' + "x" * 100_000 + '"\n1,2', ",", False), ("a," * 20_000 + "\n", ",", False)]
    rows = spark.createDataFrame(cases, "t string, d string, k boolean")
    for r in rows.select("t", "d", "k", delimited.cut_rows(F.col("t"), F.col("d"), F.col("k")).alias("rows")).collect():
        want = list(csv.reader(r["t"].splitlines(), delimiter=r["d"], skipinitialspace=r["k"]))
        full = lambda rows: [list(x) for x in rows if any(c.strip() for c in x)]
        assert full(r["rows"]) == full(want)


def test_json(parsed):
    t = parsed["a.json"]["tables"][0]
    assert t["name"] == "records" and t["columns"] == ["ship", "tons", "port", "afloat"]
    assert t["rows"] == [["Vega", "10", "", ""], ["Lyra", "", "", "true"]]
    o = parsed["o.json"]
    assert texts(o)[0].split("\n") == [
        "voyage: V-9", "days: 12.5", "master.name: R. Holm", "ports: Oslo, Kiel",
        "mixed[0]: 1", "mixed[1].k: v", "mixed[2].[0]: 2", "mixed[2].[1]: 3"]
    assert [t["name"] for t in o["tables"]] == ["legs"] and o["tables"][0]["rows"] == [["1", '{"sea":"North"}']]
    assert texts(o)[1] == 'no\tat\n1\t{"sea":"North"}'
    assert parsed["bad.json"]["error"].startswith(fv.INVALID_JSON)
    assert parsed["e.json"]["error"] == "file is empty"


def test_only_json_meets_python(spark):
    docs = spark.createDataFrame([("a.txt", "txt", b"x"), ("b.json", "json", b"[1]")], "filename string, file_type string, content binary")
    plan = files.parse(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Union") == 1
    assert {r["filename"]: r["error"] for r in files.parse(docs).collect()} == {"a.txt": None, "b.json": None}


def test_html(parsed):
    a = parsed["a.html"]["blocks"]
    assert len(a) == 1 and a[0]["heading"] == "Report & Q1" and a[0]["location"] == "body"
    assert a[0]["text"] == "Report & Q1Revenue\nStrong <quarter> &lt; café éé."
    t = parsed["t.html"]["tables"][0]
    assert t["name"] == "Table 1" and t["columns"] == ["Tree", "Age"] and t["rows"] == [["Oak", "90 y"], ["Ash", ""]]
    n = parsed["n.html"]["tables"]
    assert [x["columns"] for x in n] == [["Outerindeepdeepestside", "end"], ["indeepdeepest", "side"], ["deepdeepest"], ["deepest"]]
    assert texts(parsed["q.html"]) == ["hi\nthere"]
    assert parsed["e.html"]["error"] == "file is empty"
    assert parsed["x.exe"]["error"] == fv.UNSUPPORTED + "exe"


def test_ingest_tables(spark, tmp_path):
    (tmp_path / "head.csv").write_text("only,a,header\n")
    (tmp_path / "q.csv").write_text("region,units,date\nNorth,120,2026-01-08\nSouth,80,2026-02-11\n")
    (tmp_path / "i.txt").write_text("Vendor: Acme Corp\nTotal Rs.12.50")
    docs = files.scan_files(spark, str(tmp_path)).withColumn("document_id", F.when(F.col("filename") == "q.csv", 1).when(F.col("filename") == "i.txt", 2).otherwise(3).cast("long"))
    lib = ingest.ingest(docs)
    status = {r["document_id"]: (r["status"], r["error"]) for r in lib["documents"].collect()}
    assert status == {1: ("ready", None), 2: ("ready", None), 3: ("failed", "no extractable text")}
    assert [(c["name"], c["type"]) for c in lib["tables"].first()["columns"]] == [("region", "text"), ("units", "number"), ("date", "date")]
    assert {(r["kind"], r["value"]) for r in lib["fields"].collect()} == {("amount", "Rs.12.50"), ("pair", "Acme Corp")}
    assert {r["document_id"] for r in lib["chunks"].collect()} == {1, 2}
    assert lib["table_rows"].filter("row_index = 1").first()["cells"] == ["South", "80", "2026-02-11"]
