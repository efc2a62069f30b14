import random
import re

import numpy as np
import pytest

from quirefold.llm import decontaminate
from quirefold.llm.fmindex import FMIndex, suffix_array
from tests.llm.helpers import clashing, frame, odd_documents, prose


def words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        b = words(t)
        for window in [b[i:i + 13] for i in range(max(1, len(b) - 12))] if b else []:
            for at in range(len(w) - len(window) + 1):
                if w[at:at + len(window)] == window:
                    hit |= set(range(at, at + len(window)))
                    found |= {item} - {None}
    return len(w), hit, sorted(found)


def benchmark_rows(rows):
    rng = random.Random(9)
    long = [r[1] for r in rows if r[1] and len(r[1].split()) > 60]
    items = [(str(k), " ".join(t.split()[5:40])) for k, t in enumerate(long[:5])]
    return [*items, ("short", "alpha beta"), ("one", "word"), ("none", ""), ("null", None), (None, long[0][:90]), ("3", items[3][1]), ("new", prose(rng, 3))]


@pytest.mark.parametrize("block_bytes", [1 << 20, 4000])
def test_odd_documents(spark, block_bytes):
    rows = odd_documents()
    items = benchmark_rows(rows)
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = decontaminate.scan_documents(clashing(frame(spark, rows)), bench, block_bytes=block_bytes).collect()
    got = sorted((str(r["doc_id"]), r["n_words"], [(s["start"], s["end"]) for s in r["spans"]], r["items"]) for r in found)
    want = []
    for r in rows:
        n, hit, ids = brute(r[1], items)
        spans = [k for k in sorted(hit) if k - 1 not in hit]
        want.append((str(r[0]), n, [(a, next(e for e in range(a, n + 1) if e not in hit)) for a in spans], ids))
    assert got == sorted(want)


@pytest.mark.parametrize("action", ["drop", "cut"])
def test_clean_documents(spark, action):
    rows = odd_documents()
    items = benchmark_rows(rows)
    docs = clashing(frame(spark, rows))
    kept = decontaminate.clean_documents(docs, spark.createDataFrame(items, "item_id string, text string"), action=action)
    assert kept.columns == docs.columns
    want = []
    for r in rows:
        n, hit, _ = brute(r[1], items)
        bad = hit and 20 * len(hit) >= n
        if not bad:
            want.append((str(r[0]), str(r[1])))
        elif action == "cut":
            want.append((str(r[0]), [w for k, w in enumerate(words(r[1])) if k not in hit]))
    got = [(str(r["doc_id"]), str(r["text"])) for r in kept.collect()]
    if action == "drop":
        assert sorted(got) == sorted(want)
    else:
        assert sorted((a, tuple(words(t))) for a, t in got) == sorted((a, tuple(words(t) if isinstance(t, str) else t)) for a, t in want)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id string, text string")
    assert decontaminate.scan_documents(frame(spark, []), none).count() == 0
    found = decontaminate.scan_documents(frame(spark, odd_documents()), none)
    assert found.filter("size(spans) > 0 or size(items) > 0").count() == 0 and found.count() == len(odd_documents())


def test_index_against_plain_search():
    rng = np.random.default_rng(2)
    runs = [rng.integers(1, 6, rng.integers(1, 40)) for _ in range(30)]
    runs += [runs[0], runs[0], np.full(25, 3)]
    text = np.concatenate([np.append(r, 0) for r in runs])
    order = suffix_array(text)
    breaks = np.cumsum(text == 0)

    def suffix(p):
        out = []
        while text[p]:
            out.append((1, int(text[p])))
            p += 1
        return [*out, (0, int(breaks[p]))]

    assert order.tolist() == sorted(range(len(text)), key=suffix)
    index = FMIndex(text, 6, step=4)
    phrases = np.zeros((60, 4), np.int64)
    lengths = rng.integers(1, 5, 60)
    for k, n in enumerate(lengths):
        phrases[k, :n] = rng.integers(1, 6, n)
    low, high = index.search(phrases, lengths)
    for k, n in enumerate(lengths):
        want = [p for p in range(len(text) - n) if (text[p:p + n] == phrases[k, :n]).all()]
        assert sorted(index.locate(np.arange(low[k], high[k])).tolist()) == want


def test_blocks_are_bounded_and_keep_all_windows(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 16)
    rng = random.Random(4)
    rows = [("a", prose(rng, 40))] + [("b", prose(rng, 3))] * 500 + [(str(k), prose(rng, 2)) for k in range(30)] + [("c", "Été 漢字-x1 " * 9)]
    bench = spark.createDataFrame(rows, "item_id string, text string")
    whole = decontaminate.phrases_of(rows)
    back = lambda p: {(tuple(w for n in t if n for w, m in p.words.items() if m == n), i) for k, t in enumerate(p.table.tolist()) for i in p.items(k)}
    blocks = list(decontaminate._blocks(bench, "item_id", "text", 13, 20000))
    assert len(blocks) > 3
    assert set().union(*map(back, blocks)) == back(whole)
    assert all(len(b.table) * decontaminate.WINDOW_BYTES <= 20000 for b in blocks)
