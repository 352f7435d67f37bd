"""Packing against the tokenizer on whole texts and against dynamic programming over all cuts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from odd import SF_DIR, documents
from tokenizers import Tokenizer

from aeromosaic.llm import packing


def ids_of(text):
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [*model.encode(text or "", add_special_tokens=False).ids, 2]


def whole(pieces, texts, window):
    """Pieces give every id of every row once, sequences are gapless and fit the window."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    want, have = {}, {}
    for doc, text in texts:
        want.setdefault(doc, []).append(ids_of(text))
    for doc, own in by_doc.items():
        joined = b"".join(bytes(p["ids"]) for p in sorted(own, key=lambda p: (p["sequence_id"], p["offset"])))
        have[doc] = np.frombuffer(joined, "<u4").tolist()
    assert have.keys() == want.keys()
    for doc, lists in want.items():
        if len(lists) == 1:
            assert have[doc] == lists[0]
            assert {p["doc_tokens"] for p in by_doc[doc]} == {len(lists[0])}
            at = 0
            for p in sorted(by_doc[doc], key=lambda p: p["start"]):
                assert p["start"] == at
                at += p["length"]
        else:
            assert sorted(have[doc]) == sorted(x for ids in lists for x in ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] == len(p["ids"]) // 4 > 0
            at += p["length"]
        assert at <= window
    return [sum(p["length"] for p in own) for own in by_sequence.values()]


def cheapest(places, penalties, window):
    """Cost of the best cuts, by trying every earlier place."""
    pos, cost = [0, *places], [0]
    for i in range(1, len(pos)):
        ways = [
            cost[j] + packing.padding(pos[i] - pos[j], window) for j in range(i) if pos[i] - pos[j] <= window
        ]
        cost.append(min(ways) + 1 + penalties[i - 1])
    return cost[-1]


@pytest.mark.parametrize("seed", range(30))
def test_cuts_are_cheapest(seed):
    draw = random.Random(seed)
    window = draw.choice([8, 16, 64])
    gaps = [draw.randint(1, draw.choice([2, window // 2, window])) for _ in range(draw.randint(1, 120))]
    places = np.cumsum(gaps)
    penalties = np.array([draw.choice([0, 4, 32]) for _ in gaps])
    cuts, cost = packing.cheapest_cuts(places, penalties, window)
    assert cost == cheapest(places.tolist(), penalties.tolist(), window)
    again = dict(zip(places.tolist(), penalties.tolist()))
    lengths = np.diff([0, *cuts])
    assert lengths.max() <= window and cuts[-1] == places[-1]
    assert cost == sum(packing.padding(int(n), window) + 1 + again[c] for n, c in zip(lengths, cuts))


def test_places():
    places, costs = packing.places_to_cut(300, np.array([10, 150, 299]))
    assert places.tolist() == [10, 74, 138, 150, 214, 278, 300]
    assert costs.tolist() == [4, 32, 32, 4, 32, 32, 0]
    assert packing.places_to_cut(1, np.zeros(0, int))[0].tolist() == [1]


def test_odd_rows(odd, nothing):
    pieces = packing.pack(odd, ["doc_id"]).collect()
    texts = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    whole(pieces, texts, 4096)
    assert packing.pack(nothing, ["doc_id"]).collect() == []


def test_special_strings_and_short_runs(shipped):
    texts = [
        (1, "a <|endoftext|> b<|startoftext|>c it's 'sun 're-do. End! x y Été é x"),
        (2, " ".join(f"word{k}." for k in range(9000))),
        (3, "x" * 30_000), (4, "tail."), (5, "\u0301 İ ΣΣ. \x1c \x85 z"),
    ]
    docs = documents(shipped, [(i, t, "en") for i, t in texts]).coalesce(1)
    pieces = packing.pack(docs, ["doc_id"], window=512, run_ids=2000).collect()
    lengths = whole(pieces, texts, 512)
    assert sum(packing.padding(n, 512) for n in lengths) < 0.05 * sum(lengths)


def test_query(shipped):
    from aeromosaic.llm.texts import table

    rows = packing.op11_packing(shipped, SF_DIR).collect()
    docs = table(shipped, SF_DIR, "documents")
    pieces = packing.pack(docs, ["doc_id"]).collect()
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    lengths = whole(pieces, texts, 4096)
    assert sum(map(packing.padding, lengths)) < 0.01 * sum(lengths)
    by = {(r["doc_id"], r["start"]): r for r in rows}
    for p in pieces:
        row = by[p["doc_id"], p["start"]]
        assert row["ids_crc32"] == zlib.crc32(bytes(p["ids"])) and row["sequence_id"] == p["sequence_id"]
