"""Repair of conversations against a search over all edits, with large and spilled ones."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from odd import SF_DIR
from pyspark.sql import types as T

from aeromosaic.llm import conversations as cv

TURNS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("known", T.StringType()),
        T.StructField("fault", T.StringType()),
        T.StructField("odd`name", T.StringType()),
    ]
)
BLANKS = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        label = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(label.encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(BLANKS)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else ""
        seen.add((role, text))
        out.append(fault or ("" if bare[-1] in ".!?" else "truncated"))
    return out


def cheapest(rows, found):
    """(cost, initials, kept rows) by best-first search over (rows used, roles given)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, last, kept = heapq.heappop(heap)
        if at == len(rows) and last in ("", "a"):
            return cost, audit, list(kept)
        if (at, last) in done:
            continue
        done.add((at, last))

        def may(initial, last=last):
            return last + initial in ("s", "u", "su", "ua", "au")

        for role in ("user", "assistant"):
            if may(role[0]):
                heapq.heappush(heap, (cost + 2, audit + "I", at, role[0], (*kept, f"{role}:")))
        if at < len(rows):
            _, _, role, text = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, last, kept))
            if found[at] in ("", "truncated"):
                late = int(found[at] == "truncated")
                if role and may(role[0]):
                    heapq.heappush(heap, (cost + late, audit + "K", at + 1, role[0], (*kept, f"{role}:{text}")))
                for other in ("user", "assistant"):
                    if may(other[0]):
                        step = (cost + late + 2, audit + "R", at + 1, other[0], (*kept, f"{other}:{text}"))
                        heapq.heappush(heap, step)
    raise AssertionError


def least_audit(rows, found):
    """The cheapest edits, ties ASCII-least, from the rows' end."""
    best = {}

    def go(at, last, depth=0):
        if (at, last, depth) in best:
            return best[at, last, depth]
        ways = []
        if at == len(rows) and last in ("", "a"):
            ways.append((0, "", ()))
        if depth < 3:
            for role in ("user", "assistant"):
                if last + role[0] in ("u", "su", "ua", "au"):
                    cost, audit, kept = go(at, role[0], depth + 1)
                    ways.append((cost + 2, "I" + audit, (f"{role}:", *kept)))
        if at < len(rows):
            _, _, role, text = rows[at]
            cost, audit, kept = go(at + 1, last)
            ways.append((cost + 3, "D" + audit, kept))
            if found[at] in ("", "truncated"):
                late = int(found[at] == "truncated")
                for new, price, letter in ((role, 0, "K"), ("user", 2, "R"), ("assistant", 2, "R")):
                    if new and last + new[0] in ("s", "u", "su", "ua", "au"):
                        cost, audit, kept = go(at + 1, new[0])
                        ways.append((cost + late + price, letter + audit, (f"{new}:{text}", *kept)))
        best[at, last, depth] = min(ways) if ways else (10**9, "", ())
        return best[at, last, depth]

    return go(0, "")


def expected(rows):
    """The contract's row of every conversation."""
    out = {}
    damaged = damage(rows)
    for conv in {r[0] for r in rows}:
        own = [r for r in damaged if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        found = faults(own)
        cost, audit, kept = least_audit(own, found)
        assert cost == cheapest(own, found)[0]
        turns = {r[1] for r in own} - {None}
        legal = {"su", "ua", "au"}
        illegal = sum(a[2][:1] + b[2][:1] not in legal for a, b in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        sha = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out[conv] = (
            gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"),
            illegal, cost, audit, sha,
        )
    return out


def got(table):
    return {r["conv_id"]: tuple(r)[1:] for r in table.collect()}


def report(spark, rows, tmp_path):
    spark.createDataFrame([(*r, "x", "y", "z") for r in rows], TURNS).write.parquet(
        str(tmp_path / "conversations.parquet")
    )
    return got(cv.op12_conversations(spark, str(tmp_path)))


def test_given_conversations(shipped):
    rows = [tuple(r) for r in shipped.read.parquet(f"{SF_DIR}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    assert got(cv.op12_conversations(shipped, SF_DIR)) == expected(rows)


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(shipped, tmp_path, seed):
    draw = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "Auto", "author"]
    texts = ["Yes.", "No", "", " \n", None, "Why?", " ", "end.\t", "a!", "same", "\U0001f600"]
    rows = [
        (draw.choice([None, *range(40)]), draw.choice([None, *range(9)]), draw.choice(roles), draw.choice(texts))
        for _ in range(300)
    ]
    assert report(shipped, rows, tmp_path) == expected(rows)


def test_empty_table(shipped, tmp_path):
    assert report(shipped, [], tmp_path) == {}


def test_giant_conversation_in_little_memory(shipped, tmp_path, monkeypatch):
    """Blocks, files and batches end anywhere without a change in the result."""
    draw = random.Random(5)
    rows = [
        (7, k, draw.choice(["user", "assistant"]), draw.choice(["Yes.", f"No {k}", f"So {k}!", ""]))
        for k in range(600)
    ] + [(k, 0, "user", "Hm.") for k in range(8, 30)]
    turns = shipped.createDataFrame([(*r, "x", "y", "z") for r in rows], TURNS)
    given = cv.damaged(cv.prepared(turns))
    plain = cv.repair(given).mapInPandas(cv._digest, cv._DIGEST)
    small = cv.repair(given, limit=500).mapInPandas(cv._digest, cv._DIGEST)
    want = {tuple(r) for r in plain.collect()}
    before = shipped.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    shipped.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {tuple(r) for r in small.collect()} == want
    finally:
        shipped.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    monkeypatch.setattr(cv, "BLOCK", 3)
    spool = cv._Conversation((True, 1), 200)
    for k in range(100):
        spool.add((True, k, "user" if k % 3 else "assistant", f"text {k}.", 0))
    few = [r[6] for r in spool.repaired()]
    whole = cv._Conversation((True, 1), 1 << 20)
    monkeypatch.setattr(cv, "BLOCK", 1 << 16)
    for k in range(100):
        whole.add((True, k, "user" if k % 3 else "assistant", f"text {k}.", 0))
    assert few == [r[6] for r in whole.repaired()]


def test_repaired_rows(shipped):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Yes."), (1, 2, "user", "So"), (2, 5, "tool", "x.")]
    turns = shipped.createDataFrame([(*r, "x", "y", "z") for r in rows], TURNS)
    found = cv.repair(cv.prepared(turns)).collect()
    first = [(r["edit"], r["role"], r["text"]) for r in found if r["conv"] == 1]
    assert first == [("I", "user", ""), ("K", "assistant", "Hi."), ("K", "user", "Yes."), ("R", "assistant", "So")]
    second = [(r["edit"], r["role"]) for r in found if r["conv"] == 2]
    assert second == [("D", "tool")]
