import random
import re

import pytest

from quirefold.llm import linededup
from tests.llm.helpers import clashing, frame, odd_documents, prose


def brute(rows, min_words):
    """Kept text by (id, text): a line goes if it lies in a run of enough words that starts at an earlier place too, and not in that earliest run."""
    docs = {}
    for r in rows:
        if r[1] is not None:
            lines = [(k, x.strip(" \t\r\x0b\f")) for k, x in enumerate(r[1].split("\n"))]
            docs[(r[0], r[1])] = [(k, x) for k, x in lines if x]
    places = {}
    order = sorted(docs, key=lambda k: (k[0] is None, k[0] or 0))
    gone = {k: set() for k in docs}
    for key in order:
        lines = docs[key]
        counts = [len(re.split(r"\s+", x)) for _, x in lines]
        for i in range(len(lines)):
            for j in range(i + 1, min(len(lines), i + 2 * min_words) + 1):
                if sum(counts[i:j]) >= min_words:
                    run = tuple(x for _, x in lines[i:j])
                    if run in places:
                        first, at = places[run]
                        gone[key] |= set(range(i, j)) - (set(range(at, at + j - i)) if first == key else set())
                    else:
                        places[run] = (key, i)
    out = {}
    for key, lines in docs.items():
        numbers = {lines[i][0] for i in gone[key]}
        out[key] = ("\n".join(x for k, x in enumerate(key[1].split("\n")) if k not in numbers), len(numbers), len(lines))
    return out


def check(spark, rows, min_words):
    docs = clashing(frame(spark, rows))
    found = linededup.dedup_lines(docs, min_words=min_words).collect()
    want = brute(rows, min_words)
    got = sorted((str(r["doc_id"]), str(r["text"]), r["__deleted"], r["__lines"]) for r in found)
    expected = [(str(r[0]), *map(lambda x: x, want[(r[0], r[1])])) if r[1] is not None else (str(r[0]), "None", 0, 0) for r in rows]
    assert got == sorted(expected)
    return sum(x[2] for x in got)


@pytest.mark.parametrize("min_words", [1, 10, 50])
def test_odd_documents(spark, min_words):
    rows = [r for r in odd_documents() if r[0] != 5 or r[1] == "another text under a used id"]
    assert check(spark, rows, min_words) > 0


@pytest.mark.parametrize("seed", range(3))
def test_random_runs_over_a_small_alphabet(spark, seed):
    rng = random.Random(seed)
    lines = [prose(rng, 1, rng.randrange(1, 9)) for _ in range(7)] + ["", "  "]
    rows = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 14))), "en", "a", 0) for k in range(25)]
    check(spark, rows, 8)


def test_copies_of_long_documents(spark):
    rng = random.Random(4)
    long = prose(rng, 300, 3)
    rows = [(k, long if k % 2 else prose(rng, 2) + "\n" + long, "en", "a", 0) for k in range(8)]
    assert check(spark, rows, 50) == 7 * 300


def test_the_first_copy_stays_whole_where_copies_overlap(spark):
    same = "\n".join(["same"] * 60)
    two = "\n".join(["one two three", "four five"] * 30)
    rows = [(1, same, "en", "a", 0), (2, two, "en", "a", 0), (3, "other\n" + same, "en", "a", 0), (4, "\n".join(["same"] * 120), "en", "a", 0)]
    check(spark, rows, 50)
    found = {r["doc_id"]: r for r in linededup.dedup_lines(frame(spark, rows)).collect()}
    assert found[1]["text"] == "\n".join(["same"] * 50) and found[1]["__deleted"] == 10
    assert found[2]["text"].split("\n") == two.split("\n")[:20]
    assert found[3]["text"] == "other" and found[4]["text"] == ""


def test_empty_table(spark):
    assert linededup.dedup_lines(frame(spark, [])).count() == 0
    assert linededup.repeated_lines(frame(spark, [(1, None, None, None, None)])).count() == 0


def test_no_python_in_the_plan(spark):
    plan = linededup.dedup_lines(frame(spark, odd_documents()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
