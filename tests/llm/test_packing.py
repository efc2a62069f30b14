import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quirefold.llm import packing
from tests.llm.helpers import clashing, frame, odd_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(spark, rows, size=64, **options):
    plain = Tokenizer.from_file(PATH)
    found = packing.pack(clashing(frame(spark, rows)).repartition(4, "doc_id"), PATH, size=size, **options).toPandas()
    want = sorted((str(r[0]), [*plain.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in rows)
    docs = {}
    for r in found.itertuples():
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        key = "None" if r.doc_id != r.doc_id or r.doc_id is None else str(int(r.doc_id))
        docs.setdefault((key, r.doc_tokens), []).append((r.start, ids.tolist()))
    total = sum(len(x) for _, x in want)
    assert found.length.sum() == total
    got = {}
    for (key, n), parts in docs.items():
        counts = {}
        for start, ids in parts:
            counts.setdefault(start, []).append(ids)
        got.setdefault(key, []).append(sum(len(i) for _, i in parts) // n)
    for sequence, part in found.sort_values("offset").groupby("sequence_id"):
        ends = (part.offset + part.length).tolist()
        assert part.offset.tolist() == [0, *ends[:-1]]
        assert ends[-1] == size or sequence == found.sequence_id.max()
    assert sorted(found.sequence_id.unique()) == list(range(-(-total // size)))
    return found, want


def test_odd_documents(spark):
    found, want = check(spark, odd_documents(), grain=8)
    once = {k for k, _ in want if sum(k == x for x, _ in want) == 1}
    for key, ids in want:
        if key in once:
            own = found[found.doc_id == int(key)].sort_values("start")
            assert np.concatenate([np.frombuffer(x, "<u4") for x in own.ids]).tolist() == ids
            assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1].tolist()]
            assert set(own.doc_tokens) == {len(ids)}


def test_empty_table_and_no_end_id(spark):
    assert packing.pack(frame(spark, []), PATH).count() == 0
    docs = frame(spark, [(1, "", "en", "a", 0), (2, None, "en", "a", 0), (3, "two words", "en", None, 9)])
    rows = packing.pack(docs, PATH, end_id=None).collect()
    assert {r["doc_id"] for r in rows} == {3} and rows[0]["source"] is None


def test_windows_follow_the_mixture(spark):
    rows = [(k, "one two three four five six seven eight nine ten " * 20, "en", "abcd"[min(3, k % 8)], 0) for k in range(160)]
    found, _ = check(spark, rows, size=512, grain=32)
    share = found.groupby("source").length.sum() / found.length.sum()
    full = found[found.sequence_id < found.sequence_id.max()]
    for source, part in full.groupby("source"):
        by_window = part.groupby("sequence_id").length.sum().reindex(range(full.sequence_id.max() + 1), fill_value=0)
        owed = np.cumsum(by_window.to_numpy()) - share[source] * 512 * np.arange(1, len(by_window) + 1)
        assert np.abs(owed).max() <= 64  # the deficit never grows beyond two turns


def test_weights_drain_a_queue_early(spark):
    rows = [(k, "one two three four five " * 40, "en", "ab"[k % 2], 0) for k in range(40)]
    found, _ = check(spark, rows, size=256, grain=16, weights={"a": 0.75, "b": 0.25})
    early = found[found.sequence_id < 10].groupby("source").length.sum()
    assert abs(early["a"] / early.sum() - 0.75) < 0.03
    assert found[found.source == "a"].sequence_id.max() < found[found.source == "b"].sequence_id.max()


def test_many_sources_share_a_queue(spark):
    rows = [(k, "text of a source " * (k % 5 + 1), "en", f"s{k % 30}", 0) for k in range(90)]
    check(spark, rows, size=128, grain=16, queues=6)


def test_sources_beyond_the_queues_keep_their_shares(spark):
    rows = [(k, "one two three four five six seven eight nine ten " * 8, "en", f"s{k % 3 if k % 2 else 3 + k % 61}", 0) for k in range(600)]
    found, _ = check(spark, rows, size=512, grain=16, queues=5)
    total = found.length.sum()
    for source, part in found.groupby("source"):
        had = part.groupby("sequence_id").length.sum().reindex(range(found.sequence_id.max() + 1), fill_value=0).cumsum()
        owed = had - part.length.sum() / total * 512 * (found.sequence_id.drop_duplicates().sort_values().to_numpy() + 1)
        assert owed[:-1].abs().max() <= 16 * 4  # a turn or so at each level


def test_weights_of_a_rare_source(spark):
    rows = [(k, "one two three four five " * 40, "en", "z" if k % 20 == 0 else f"s{k % 20 // 2}", 0) for k in range(200)]
    found, _ = check(spark, rows, size=256, grain=16, queues=4, weights={"z": 0.5})
    early = found[found.sequence_id < 5].groupby("source").length.sum()
    assert early.get("z", 0) / early.sum() > 0.3


@pytest.mark.parametrize("totals", [[500, 20, 300, 7, 1, 64, 8], [9, 9, 9, 9, 9, 9], [40] * 30])
@pytest.mark.parametrize("queues", [1, 2, 3])
def test_every_token_of_a_tree_has_its_place(totals, queues):
    tree = packing.Tree(np.array(totals), np.array(totals) / sum(totals), 8, queues)
    n = np.array(totals)
    row, start, length, window, offset = tree.pieces(np.arange(len(n)), np.zeros(len(n), np.int64), n, 32)
    at = np.concatenate([np.arange(k) + w * 32 + o for k, w, o in zip(length, window, offset)])
    assert sorted(at.tolist()) == list(range(sum(totals)))
    assert np.array_equal(np.bincount(row, length), n)


@pytest.mark.parametrize("totals,weights", [([100, 37, 1, 64], [100, 37, 1, 64]), ([64, 64, 64], [1, 1, 1]), ([500, 20, 300], [1, 7, 2]), ([9, 0, 9], [3, 1, 3])])
def test_places_are_those_of_the_merged_turns(totals, weights):
    schedule = packing.Schedule(np.array(totals), np.array(weights, float), 8)
    turns = [((2 * k + 1) * 8 / (2 * w), q, k) for q, (n, w) in enumerate(zip(totals, weights)) for k in range(-(-n // 8))]
    at = 0
    for _, q, k in sorted(turns):
        assert schedule.place(np.array([q]), np.array([k]))[0] == at
        at += min(8, totals[q] - 8 * k)


def test_encoder_equals_the_tokenizers_library(tmp_path):
    plain = Tokenizer.from_file(PATH)
    texts = [r[1] or "" for r in odd_documents()] + ["<|endoftext|>", "a <|endoftext|> b", "  \n\n\t x", "don't we'll I'M", "x" * 25000, "1234567 ½ ² 漢字 🙂"]
    assert [x.tolist() for x in packing.encoder(packing.vocabulary(PATH))(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    word = public_tokenizers.path("word_bpe_49k.json")
    other = Tokenizer.from_file(word)
    assert [x.tolist() for x in packing.encoder(packing.vocabulary(word))(texts[:5])] == [other.encode(t, add_special_tokens=False).ids for t in texts[:5]]
    assert packing.vocabulary(PATH).ranks and packing.vocabulary(word).ranks is None


def test_long_words_are_encoded_in_time():
    """Words of any length, just below and above the length from which the library takes them."""
    import random
    import time

    known = packing.vocabulary(PATH)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij0123456789") for _ in range(n)) for n in (4999, 5000, 19_999, 20_001, 200_000)]
    encode, plain = packing.encoder(known), Tokenizer.from_file(PATH)
    began = time.process_time()
    found = encode([*words, " ".join(words)])
    assert time.process_time() - began < 5
    assert [x.tolist() for x in found[:2]] == [plain.encode(w, add_special_tokens=False).ids for w in words[:2]]


def test_ranks_only_for_files_of_known_parts():
    with open(PATH, encoding="utf-8") as file:
        text = file.read()
    ranks = packing._ranks(json.loads(text))
    assert ranks and packing.vocabulary(PATH).ranks == ranks
    merges = json.loads(text)["model"]["merges"]
    for part, value in [
        (("normalizer",), {"type": "NFC"}), (("pre_tokenizer",), {"type": "Whitespace"}), (("pre_tokenizer", "add_prefix_space"), True),
        (("pre_tokenizer", "use_regex"), False), (("post_processor",), {"type": "Sequence"}), (("model", "type"), "WordPiece"),
        (("model", "ignore_merges"), True), (("model", "unk_token"), "<unk>"), (("model", "merges"), merges[::-1]), (("model", "merges"), merges[1:]),
    ]:
        spec = json.loads(text)
        at = spec
        for name in part[:-1]:
            at = at[name]
        at[part[-1]] = value
        assert packing._ranks(spec) is None, part
