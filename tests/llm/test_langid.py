import math
import re
import zlib

import numpy as np

from quirefold.llm import langid
from tests.llm.helpers import clashing, frame, odd_documents

DOCS = "/root/testdata/sf0.01/documents.parquet"


def test_gradient_is_that_of_the_loss():
    net = langid.Net.fresh(["a", "b", "c"])
    rng = np.random.default_rng(1)
    for p in net.params():
        p[...] = rng.standard_normal(p.shape) * 0.3
    for name in ("embed", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.filters = [f.astype(np.float64) for f in net.filters]
    net.biases = [b.astype(np.float64) for b in net.biases]
    windows, labels = rng.integers(0, 256, (5, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    loss = lambda: -np.log(net.forward(windows)[np.arange(5), labels]).mean()
    for p, g in zip(net.params(), net.gradient(windows, labels)):
        for at in [np.unravel_index(k, p.shape) for k in np.argsort(-np.abs(g).ravel())[:3]]:
            old = p[at]
            p[at] = old + 1e-6
            up = loss()
            p[at] = old - 1e-6
            down = loss()
            p[at] = old
            assert abs((up - down) / 2e-6 - g[at]) < 1e-4 * max(1, abs(g[at]))


def test_tables_give_the_same_probabilities():
    net = langid.Net.fresh(["a", "b"])
    windows = np.random.default_rng(0).integers(0, 256, (7, langid.WINDOW)).astype(np.uint8)
    assert np.allclose(net.forward(windows), net.predict(windows, net.tables()), atol=1e-5)


def test_windows_cover_whole_texts():
    text = bytes(range(1, 256)) * 3
    windows = langid.windows_of(text)
    assert windows.tobytes()[:len(text)] == text and not any(windows.tobytes()[len(text):])
    assert langid.windows_of(b"").shape == (1, langid.WINDOW)


def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet(DOCS)
    rows = langid.identify(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 150
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.97


def test_held_out_labels_teach_nothing(spark):
    docs = spark.read.parquet(DOCS).limit(200)
    rows = docs.collect()
    held = {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    changed = docs.withColumn("lang", __import__("pyspark").sql.functions.expr("if(crc32(string(doc_id)) % 4 = 2, 'xx', lang)"))
    assert held and set(r["lang"] for r in langid.sample(changed, "doc_id", "text", "lang").collect()) <= {r["lang"] for r in rows}


def test_odd_documents(spark):
    rows = odd_documents()
    docs = clashing(frame(spark, rows))
    net = langid.Net.fresh(["de", "en"])
    found = langid.identify(docs, net).collect()
    assert len(found) == len(rows)
    kinds = sorted((str(r["doc_id"]), r["held_out"], r["lang_pred"] == "und") for r in found)
    assert kinds == sorted(
        (str(r[0]), zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 4 == 2, not re.search(r"[^\W\d_]", r[1] or "")) for r in rows
    )
    assert all(0 <= r["score"] <= 1 for r in found)


def test_without_labels_or_rows(spark):
    docs = frame(spark, [(1, "text", None, "a", 4), (2, None, "en", "a", 0)])
    assert langid.fit(docs) is None
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}
    empty = frame(spark, [])
    assert langid.identify(empty, langid.fit(empty)).count() == 0


def plainly(net, text):
    """The definition once more, a number at a time: windows, filters, best responses, softmax, mean by bytes."""
    raw, total = text.encode(), [0.0] * len(net.langs)
    for at in range(0, len(raw), langid.WINDOW):
        own = raw[at:at + langid.WINDOW]
        window = own + bytes(langid.WINDOW - len(own))
        hidden = []
        for width, weights, bias in zip(langid.WIDTHS, net.filters, net.biases):
            for f in range(langid.FILTERS):
                best = max(
                    sum(float(net.embed[window[s + k]][e]) * float(weights[k * langid.EMBED + e][f]) for k in range(width) for e in range(langid.EMBED))
                    for s in range(langid.WINDOW - width + 1)
                )
                hidden.append(max(best + float(bias[f]), 0.0))
        logits = [sum(h * float(net.out[j][c]) for j, h in enumerate(hidden)) + float(net.out_bias[c]) for c in range(len(net.langs))]
        powers = [math.exp(x - max(logits)) for x in logits]
        total = [t + len(own) * p / sum(powers) for t, p in zip(total, powers)]
    shares = [t / len(raw) for t in total]
    return net.langs[shares.index(max(shares))], max(shares)


def test_identify_against_the_definition(spark):
    net = langid.Net.fresh(["de", "en", "fr"])
    texts = ["one short text", "Über die Äcker " * 12, "漢字 and more " * 9, "x" * langid.WINDOW, "last one, of " + "many words " * 30]
    found = langid.identify(frame(spark, [(k, t, None, None, None) for k, t in enumerate(texts)]), net).collect()
    for r in found:
        lang, score = plainly(net, texts[r["doc_id"]])
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-4
