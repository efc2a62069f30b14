import random
import re

import pytest

from quirefold.llm import linerules
from tests.llm.helpers import SCHEMA, clashing, frame, odd_documents, prose

WORD = re.compile("[^ \t-\r]+")
ENDS = tuple(".!?:;…。！？")
CLOSERS = "\"')]}»”’“"


def brute_line(line: str) -> str | None:
    """The rules by characters and words, without byte patterns."""
    words = WORD.findall(line)
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in line)
    separators = [w for w in words if w in linerules.SEPARATORS]
    if len(separators) >= 2 and len(separators) / len(words) >= 1 / 8:
        return "navigation"
    parts = "".join(c if c.isascii() and (c.islower() or c.isdigit()) or not c.isascii() else " " for c in low).split(" ")
    menu = [p for p in parts if p in linerules.MENU_WORDS]
    if len(menu) >= 2 and len(menu) / len(words) >= 1 / 2:
        return "navigation"
    said = [p for p in linerules.PHRASES if p in low]
    if said and len(words) <= linerules.PHRASE_WORDS * len(said):
        return "boilerplate"
    loud = [w for w in words if len(w) > 1 and all(c in "!?#$%&*@~=+<>^_|\\" for c in w[-2:])]
    if len(loud) / len(words) > 1 / 4:
        return "punctuation"
    closing = [k for k, w in enumerate(words) if w.rstrip(CLOSERS).endswith(ENDS)]
    open_words = len(words) - (closing[-1] + 1 if closing else 0)
    return "punctuation" if open_words > len(words) / 2 else None


def brute(text: str | None) -> dict:
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    again = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = text.split("\n")
    full = [x for x in lines if WORD.search(x)]
    verdicts = {x: brute_line(x) for x in full}
    lost = sum(len(WORD.findall(x)) for x in full if verdicts[x])
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": sum(x in full[:k] for k, x in enumerate(full)), "n_repeat_words": len(again), "lost_words": lost,
        "base_failed": failed, "kept": not failed and lost <= 0.2 * len(words),
        **{f"n_{r}": sum(verdicts[x] == r for x in full) for r in linerules.RULES},
        "text": "\n".join(x for x in lines if not verdicts.get(x)),
    }


BODY = "Rain fell over the harbour all night, and the boats stayed in. Nobody minded much; there was work enough ashore for everyone who wanted it."
LINES = [
    ("Home | News | Sport | Weather", "navigation"), ("Home Contact About", "navigation"), ("He went home, and about time.", None),
    ("All rights reserved.", "boilerplate"), ("ACCEPT COOKIES or leave.", "boilerplate"), (BODY + " Read more about it in the log.", None),
    ("Chapter One", "punctuation"), ("STOP!! READ!! THIS!! NOW!!", "punctuation"), ("He said “no.”", None), ("Sie ging (endlich!) fort…", None),
    ("One two three. Four five six seven.", None), ("One two. Three four five six seven", "punctuation"), ("a b c. d e f", None), (".", None),
    ("x | y", "punctuation"), ("»Quoi ?«", "punctuation"), ("漢字。", None), ("word##", "punctuation"), ("\t \r", None), ("5 > 3 and 7 > 2.", "navigation"),
]


@pytest.mark.parametrize("line, rule", LINES)
def test_lines(line, rule):
    if line.strip(" \t\r"):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in line).encode()
        found = linerules.failing_rule(line.encode(), line.encode().split(), low, [p.encode() for p in linerules.PHRASES if p.encode() in low])
        assert (None if found is None else linerules.RULES[found]) == rule
        assert brute_line(line) == rule
    found = linerules.judge(line.encode())
    assert sum(found.failed) == (rule is not None)


def documents():
    rows = [r for r in odd_documents() if r[1] is None or len(r[1]) < 20000]
    body = prose(random.Random(3), 12)
    junk = "\n".join(x for x, rule in LINES if rule)
    more = [body + "\n" + junk, junk + "\n" + body + "\n\n" + body, "\n".join(x for x, _ in LINES), "a a a a a a", "x\r\nx\r\nx", "w " * 60, body.replace(" ", "\x0b")]
    return rows + [(100 + k, t, "en", "a", 0) for k, t in enumerate(more)]


def test_measures_against_brute_force(spark):
    rows = documents()
    found = linerules.measure(clashing(frame(spark, rows))).collect()
    want = [(str(r[0]), brute(r[1])) for r in rows]
    keys = [k for k in want[0][1] if k != "text"]
    assert sorted((str(r["doc_id"]), *(r[k] for k in keys)) for r in found) == sorted((i, *(w[k] for k in keys)) for i, w in want)
    assert len({r["kept"] for r in found}) == 2


def test_clean_texts(spark):
    rows = documents()
    docs = clashing(frame(spark, rows))
    found = linerules.clean(docs)
    assert found.schema == docs.schema
    want = sorted((str(r[0]), w["text"]) for r in rows if (w := brute(r[1]))["kept"])
    assert sorted((str(r["doc_id"]), r["text"]) for r in found.collect()) == want
    assert any(t != r[1] for r in rows for i, t in want if i == str(r[0]))


def test_very_long_texts_and_empty_table(spark):
    long = prose(random.Random(5), 6000)
    one_line = "word " * 300_000
    found = {r["doc_id"]: r for r in linerules.measure(frame(spark, [(1, long, "en", "a", 0), (2, one_line, "en", "a", 0)])).collect()}
    assert found[1]["kept"] and found[1]["n_words"] == 72000
    assert found[2]["base_failed"] and found[2]["n_repeat_words"] == 300_000
    assert linerules.measure(spark.createDataFrame([], SCHEMA)).count() == linerules.clean(spark.createDataFrame([], SCHEMA)).count() == 0


def test_labels(spark):
    """Labelled documents that pass the base rules: good ones stay, bad ones go."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = linerules.measure(docs).filter("not base_failed").join(labels, "doc_id").select("quality", "kept").collect()
    good, bad = ([r["kept"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert len(bad) > 50 and sum(good) >= 0.99 * len(good) and sum(bad) <= 0.05 * len(bad)


def test_menus_longer_than_the_word_list():
    """A line of menu words is navigation at any length; words that repeat count each time."""
    for words, rule in ((["Home", "Menu", "Login."] * 40, 0), (["Home", "the."] * 60, 0), (["Home", "the", "cat."] * 60, None)):
        line = " ".join(words)
        found = linerules.failing_rule(line.encode(), line.encode().split(), line.lower().encode(), [])
        assert found == rule and brute_line(line) == (None if rule is None else linerules.RULES[rule])
