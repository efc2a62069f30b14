import random
import re

import numpy as np
import xxhash

from quirefold.llm import simhash
from quirefold.llm.components import components
from tests.llm.helpers import SCHEMA, clashing, frame, odd_documents


def brute_print(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints):
    root = list(range(len(prints)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def expected(rows):
    prints = [brute_print(r[1]) for r in rows]
    classes = brute_classes(prints)
    least = {}
    for r, c in zip(rows, classes):
        ids = [x for x in (least.get(c), r[0]) if x is not None]
        least[c] = min(ids) if ids else None
    return [(r[0], p, least[c]) for r, p, c in zip(rows, prints, classes)]


def key(row):
    return tuple((x is None, x or 0) for x in row)


def test_classes_of_odd_documents(spark):
    rows = odd_documents()
    found = simhash.near_duplicates(clashing(frame(spark, rows))).collect()
    got = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in found]
    assert sorted(got, key=key) == sorted(expected(rows), key=key)


def test_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert simhash.keep_first(frame(spark, [])).count() == 0


def test_keep_first_leaves_one_row_of_each_class(spark):
    rows = odd_documents()
    docs = clashing(frame(spark, rows))
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    classes = {}
    for row, (_, p, component) in zip(rows, expected(rows)):
        classes.setdefault((component,) if component is not None else ("fp", p), set()).add(row[0])
    got = sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x or 0))
    want = sorted((min((x for x in ids if x is not None), default=None) for ids in classes.values()), key=lambda x: (x is None, x or 0))
    assert got == want


def test_forest_connects_what_brute_force_links():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    values = np.unique(np.concatenate([base, *[base ^ np.uint64(1 << int(rng.integers(64))) ^ np.uint64(1 << int(rng.integers(64))) for _ in range(6)]]))
    left, right = values[::2], values[1::2]
    edges = [simhash.forest(left, None, 4), simhash.forest(right, None, 4), simhash.forest(left, right, 4)]
    u, v = (np.concatenate(x).tolist() for x in zip(*edges))
    assert all(len(e[0]) < len(values) for e in edges)
    number = {x: k for k, x in enumerate(values.tolist())}
    root = list(range(len(values)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in zip(u, v):
        root[find(number[a])] = find(number[b])
    want = brute_classes(values.tolist())
    pairs = {(find(i), want[i]) for i in range(len(values))}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_links_with_many_small_tiles(spark):
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(300)]
    prints += [p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for p in prints[:150]]
    prints = list(dict.fromkeys(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), 4, 20, 30)
    roots = {r["node"]: r["root"] for r in components(edges).collect()}
    want = brute_classes(prints)
    pairs = {(roots.get(s, s), w) for s, w in zip(signed, want)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_tile_plan_meets_all_close_tiles():
    counts = {k: (k - 20) ** 2 if 20 <= k <= 44 else 0 for k in range(65)}
    plan = simhash.tile_plan(counts, 4, 100, 8)
    for a in range(65):
        for b in range(max(0, a - 4), min(64, a + 4) + 1):
            assert plan["first"][a] <= plan["base"][b] and plan["base"][b] + plan["split"][b] - 1 <= plan["last"][a]


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}}


def test_schema_is_that_of_the_helper(spark):
    assert frame(spark, []).columns == [x.split()[0] for x in SCHEMA.split(", ")]
