import random

from quirefold.llm import licences
from tests.llm.helpers import clashing, frame, odd_documents


def brute(text, templates, least):
    lines = (text or "").split("\n")
    words = [licences.words_of(x) for x in lines]
    units = [(k, k, w) for k, w in enumerate(words, 1) if w]
    k = 0
    while k < len(words):
        e = k
        while e < len(words) and words[e]:
            e += 1
        if e - k > 1 and e - k < len(words):
            units.append((k + 1, e, sum(words[k:e], [])))
        k = e + 1
    if len(lines) > 1:
        units.append((1, len(lines), sum(words, [])))
    out = []
    for first, last, w in units:
        best = {}
        for name, t in templates:
            a, b = set(zip(w, w[1:])), licences.bigrams(licences.words_of(t))
            if a and b:
                best[name] = max(best.get(name, 0), 2 * len(a & b) / (len(a) + len(b)))
        top = max(best.values(), default=0)
        out += [(n, v, first, last) for n, v in best.items() if v == top and v >= least]
    return sorted(out, key=lambda x: (x[2], x[3], x[0]))


def texts():
    rng = random.Random(2)
    notice = [t for _, t in licences.TEMPLATES]
    mit = notice[3]
    wrapped = "\n".join(mit[k:k + 60] for k in range(0, len(mit), 60))
    words = notice[4].split()
    out = ["\n".join([rng.choice(notice), "plain words here", rng.choice(notice).upper()]) for _ in range(10)]
    out += [wrapped, "code above\n\n" + wrapped + "\n\ncode below", " ".join(words[1:]) + " indeed", "MIT MIT MIT", mit + " " + mit, "a b " * 300]
    return out


def test_against_brute_force(spark):
    rows = odd_documents() + [(1000 + k, t, "en", "a", 0) for k, t in enumerate(texts())]
    for least in (0.5, 0.8, 1.0):
        found = licences.scan(clashing(frame(spark, rows)), least=least).collect()
        got = sorted((str(r["doc_id"]), [(m["licence"], m["dice"], m["first"], m["last"]) for m in r["matches"]]) for r in found)
        assert got == sorted((str(r[0]), brute(r[1], licences.TEMPLATES, least)) for r in rows)


def test_template_table_and_empty(spark):
    table = spark.createDataFrame([("X", "some own notice of terms"), (None, "x y"), ("Y", None), ("Z", "one")], "licence string, text string")
    docs = frame(spark, [(1, "Some own notice, of terms!", "en", "a", 0), (2, None, None, None, None)])
    got = {r["doc_id"]: [m["licence"] for m in r["matches"]] for r in licences.scan(docs, table).collect()}
    assert got == {1: ["X"], 2: []}
    assert licences.scan(frame(spark, [])).count() == 0
    assert licences.scan(docs, table.limit(0)).filter("size(matches) > 0").count() == 0


def told(text, templates=None):
    return [(n, a, b) for n, _, a, b in licences.scan_text(text, licences.Library.of(templates or licences.all_templates()), runs=True)]


def test_runs_of_sentences_and_lines():
    mit = licences.TEMPLATES[3][1]
    parts = [mit[:mit.index("The above")], mit[mit.index("The above"):mit.index("THE SOFTWARE IS")], mit[mit.index("THE SOFTWARE IS"):]]
    wrapped = ["\n".join(" * " + p[k:k + 60] for k in range(0, len(p), 60)) for p in parts]
    header = "/*\n" + "\n *\n".join(wrapped) + "\n */\n" + "".join(f"int f{k}(int a{k}) {{\n  return g{k} + h{k};\n}}\n" for k in range(99))
    assert told(header) == [("MIT", 2, header[:header.index("\n */")].count("\n") + 1)]
    assert told("\n\n".join(parts) + "".join(f"\n\nvoid f{k}(int a{k}, int b{k});" for k in range(99))) == [("MIT", 1, 5)]
    assert told("Released under the MIT License. See the file LICENSE for details.") == [("MIT", 1, 1)]
    assert told("Copyright 2020 Jane Doe. All rights reserved.") == [("All-Rights-Reserved", 1, 1)]
    assert told("Some words of a story here. " * 30 + "Licensed under CC BY-SA 4.0. " + "More words of it follow. " * 30) == [("CC-BY-SA-4.0", 1, 1)]
    assert told("plain text. " * 50 + "\n" + "the license of the software. " * 50) == []
    assert told(mit + "\n" + "\n".join([f"word{k} of it" for k in range(300)] + [mit])) == [("MIT", 1, 1), ("MIT", 302, 302)]


def test_full_texts():
    for name, text in licences.all_templates()[len(licences.TEMPLATES) + len(licences.NOTICES):]:
        assert {n for n, *_ in told("Some words. " * 2000 + "\n" + text + "\nfoo bar baz\n" * 2000)} & {"AGPL-3.0", "BSD-2-Clause", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", name} == {name}


def test_best_run_of_all(seed=7):
    """The best run of a template is the best of all runs of atoms, by brute force."""
    rng = random.Random(seed)
    for _ in range(300):
        template = [rng.choice("abcdef") for _ in range(rng.randrange(2, 9))]
        atoms = [[rng.choice("abcdefgh") for _ in range(rng.randrange(1, 5))] for _ in range(rng.randrange(1, 12))]
        spot = rng.randrange(len(atoms) + 1)
        atoms[spot:spot] = [template[:3], template[3:] or ["x"]]
        text, least = ". ".join(" ".join(a) for a in atoms), rng.choice([0.5, 0.8, 1.0])
        library = licences.Library.of([("T", " ".join(template))])
        values = [licences.dice(licences.bigrams(sum(atoms[i:j], [])), library.sets[0]) for i in range(len(atoms)) for j in range(i + 1, len(atoms) + 1)]
        best = max((v for v in values if v >= least), default=0)
        got = licences.matching_runs(text, licences.words_of(text), library, least, [])
        assert abs(max((v for _, v, *_ in got), default=0) - best) < 1e-9
