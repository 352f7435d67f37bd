"""Spelling variants against a comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from odd import SF_DIR

from aeromosaic.llm import spelling


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def neighbours(words):
    """Near words of each word, through the strings that one deletion leaves."""
    by = {}
    for w in words:
        for v in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            by.setdefault(v, []).append(w)
    near = {w: set() for w in words}
    for group in by.values():
        for a in group:
            near[a].update(b for b in group if one_edit(a, b))
    return near


def expected(counts):
    near, form, out = neighbours(counts), {}, {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts.get(form[w]))
    return out


def counted(docs):
    found = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if n >= 3 and len(w) >= 5}


def got(table):
    return {r["word"]: tuple(r[c] for c in ("form", "root", "n", "n_near", "form_n")) for r in table.collect()}


def test_query(shipped, given):
    want = expected(counted([(i, t) for i, t, _ in given]))
    assert got(spelling.op13_spelling(shipped, SF_DIR)) == want


@pytest.mark.parametrize("crowd", [10_000, 12, 2])
def test_random_words(shipped, crowd):
    """Few letters, so that words have many near words; small crowds split their keys to the end."""
    draw = random.Random(crowd)
    words = {"".join(draw.choices("abé", k=draw.randint(1, 9))) for _ in range(900)}
    words |= {"stem" * 40 + w for w in list(words)[:60]} | {w + "ÿ" * 30 for w in list(words)[:60]}
    counts = {w: draw.choice([3, 4, 6, 8, 100, 100, 5000]) for w in words}
    table = shipped.createDataFrame(list(counts.items()), "word string, n long")
    assert got(spelling.variants(table, crowd=crowd)) == expected(counts)


def test_small_batches(shipped, monkeypatch):
    words = sorted({"".join(random.Random(k).choices("xyz", k=6)) for k in range(300)})
    rows = [w.encode() for w in words]
    import numpy as np

    groups = np.zeros(len(rows), int)
    found = spelling.near_pairs(rows, groups, groups + 6, groups)[0]
    have = {(words[a], words[b]) for a, b in found.tolist()}
    assert have == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}


def test_odd_rows(odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert got(spelling.variants(spelling.word_counts(odd, plant=True))) == expected(counted(rows))
    assert got(spelling.variants(spelling.word_counts(nothing))) == {}
