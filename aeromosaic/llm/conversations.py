"""Repair of the structure of conversations by the cheapest edits, streamed in order of turns.

Rows are dealt by conversation and sorted by turn inside the tasks, so that a conversation passes
as a stream over any number of Arrow batches. Kept turns must give role initials of an optional system
turn and then pairs of user and assistant, or nothing at all. A row is kept (0), given the
other role (2) or deleted (3; blank and repeated rows must be); an empty user or assistant turn
is put in anywhere (2); a truncated row that stays costs 1. Of the cheapest edits those whose initials
come first in ASCII are taken.

A row adds one byte to the state, its role initial and fault, and its text to the held rows. At
the end of a conversation the bytes are gone through backwards: four costs, one for each state of the
automaton, and one byte of backpointers a row, the first initial of the best edits from each state.
Then rows and backpointers are read forwards and edits are emitted. Bytes and rows beyond
``HELD`` bytes are spilled to files of the task that have no name and end with it, so a giant conversation
needs bounded memory.

Nulls in role and text count as one space; null turns come first; a null conv_id is a conversation of
its own. Rows of equal turn go by role, then text. Further columns are not looked at; an empty table gives
an empty result.
"""

import hashlib
import pickle
import tempfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeromosaic.llm.texts import named, table

HELD = 32 << 20  # bytes of a conversation that a task keeps in memory, and of its states
BLOCK = 1 << 16  # rows whose states are read at once
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
_COSTS = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}
FAULTS = ("", "blank", "duplicate", "truncated")

# States: nothing yet, after system, after user, after assistant; a conversation ends in the first or last.
_STATES = 4
_ENDS = (0, None, None, 0)
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_OTHER = ("u", "u", "a", "u")  # the role that may come next, if not system
_ROLE = {"u": "user", "a": "assistant"}
_LETTERS = "DIKR"  # in order of ASCII, as numbers 0 to 3
_FAR = 1 << 40

REPAIRED = (
    "known boolean, conv long, turn_known boolean, turn long, old_role string, fault string, edit string,"
    " role string, text string"
)


class Spool:
    """Byte strings in order, beyond a limit in an unnamed file of the task, read from either end."""

    def __init__(self, limit: int = HELD):
        self.limit, self.held, self.size, self.file, self.places = limit, [], 0, None, []

    def add(self, data: bytes):
        self.held.append(data)
        self.size += len(data)
        if self.size > self.limit:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            self.file.seek(0, 2)
            for part in self.held:
                self.places.append((self.file.tell(), len(part)))
                self.file.write(part)
            self.held, self.size = [], 0

    def __len__(self):
        return len(self.places) + len(self.held)

    def read(self, k: int) -> bytes:
        if k >= len(self.places):
            return self.held[k - len(self.places)]
        at, size = self.places[k]
        self.file.seek(at)
        return self.file.read(size)

    def close(self):
        if self.file is not None:
            self.file.close()


def row_code(initial: str, fault: int) -> int:
    """Role initial (other than s, u, a: 3) and fault of a row in one byte."""
    return "sua".find(initial) % 4 * 4 + fault if initial else 12 + fault


def _layer(after: tuple, code: int) -> tuple[tuple, int]:
    """Costs to the end from each state before a row, and the letters of the best first edits.

    ``after`` has the costs behind the row, insertions there included.
    """
    initial, fault = "sua "[code // 4], code % 4
    stays = fault not in (BLANK, DUPLICATE)
    late = int(fault == TRUNCATED)
    cost, letter = [], []
    for state in range(_STATES):
        ways = [(DELETE + after[state], 0)]
        if stays and (state, initial) in _NEXT:
            ways.append((KEEP + late + after[_NEXT[state, initial]], 2))
        if stays:
            ways.append((REROLE + late + after[_NEXT[state, _OTHER[state]]], 3))
        best = min(ways)
        cost.append(best[0])
        letter.append(best[1])
    return _with_inserts(cost, letter)


def _with_inserts(cost: list, letter: list) -> tuple[tuple, int]:
    """Costs with turns put in first where that is cheaper, or as cheap and first in ASCII."""
    for _ in range(_STATES):  # every round lets one more insertion in
        for state in range(_STATES):
            other = INSERT + cost[_NEXT[state, _OTHER[state]]]
            if (other, 1) < (cost[state], letter[state]):
                cost[state], letter[state] = other, 1
    return tuple(cost), sum(k << 2 * s for s, k in enumerate(letter))


def _backpointers(codes: Spool, limit: int) -> Spool:
    """Blocks of backpointers of the rows, last block first."""
    after, _ = _with_inserts([0 if e == 0 else _FAR for e in _ENDS], [0] * _STATES)
    known, found = {}, Spool(limit)
    for k in range(len(codes) - 1, -1, -1):
        block = codes.read(k)
        out = bytearray(len(block))
        for row in range(len(block) - 1, -1, -1):
            step = known.get((after, block[row]))
            if step is None:
                cost, byte = _layer(after, block[row])
                least = min(cost)
                step = known[after, block[row]] = tuple(c - least for c in cost), byte
            after, out[row] = step
        found.add(bytes(out))
    return found


def edits_of(backpointers: Spool, codes: Spool):
    """(row or None for an insertion, letter, role put in or given) of the cheapest edits, in order."""
    state, row = 0, 0
    blocks = len(codes)
    for k in range(blocks):
        block, letters = codes.read(k), backpointers.read(blocks - 1 - k)
        for code, byte in zip(block, letters, strict=True):
            while (letter := byte >> 2 * state & 3) == 1:
                yield None, "I", _ROLE[_OTHER[state]]
                state = _NEXT[state, _OTHER[state]]
            if letter == 2:
                state = _NEXT[state, "sua "[code // 4]]
                yield row, "K", None
            elif letter == 3:
                yield row, "R", _ROLE[_OTHER[state]]
                state = _NEXT[state, _OTHER[state]]
            else:
                yield row, "D", None
            row += 1
    while _ENDS[state] is None:
        yield None, "I", _ROLE[_OTHER[state]]
        state = _NEXT[state, _OTHER[state]]


class _Conversation:
    """The rows of one conversation so far: (turn_known, turn, role, text, fault)."""

    def __init__(self, key, limit):
        self.key, self.limit = key, limit
        self.codes, self.open = Spool(limit), bytearray()
        self.rows, self.held, self.size = Spool(0), [], 0

    def add(self, row: tuple):
        self.open.append(row_code(row[2][:1], row[4]))
        self.held.append(row)
        self.size += len(row[3]) + 100
        if self.size > self.limit:
            self.rows.add(pickle.dumps(self.held))
            self.held, self.size = [], 0
        if len(self.open) >= BLOCK:
            self._block()

    def _block(self):
        self.codes.add(bytes(self.open))
        self.open = bytearray()

    def _kept(self):
        for k in range(len(self.rows)):
            yield from pickle.loads(self.rows.read(k))
        yield from self.held

    def repaired(self):
        """Rows of REPAIRED, in order."""
        self._block()
        back = _backpointers(self.codes, self.limit)
        rows = self._kept()
        for row, edit, role in edits_of(back, self.codes):
            if row is None:
                yield *self.key, False, 0, None, "", edit, role, ""
            else:
                turn_known, turn, old, text, fault = next(rows)
                yield *self.key, turn_known, turn, old, FAULTS[fault], edit, role or old, text
        for spool in (self.codes, self.rows, back):
            spool.close()


def _stream(limit):
    """Repairs conversations that arrive sorted, each wherever batches begin and end."""
    names = [field.split()[0] for field in REPAIRED.split(",")]
    whole = names.index("text")

    def frames(rows):
        """Frames of a few thousand rows or some megabytes."""
        block, size = [], 0
        for row in rows:
            block.append(row)
            size += len(row[whole]) + 200
            if len(block) >= 4096 or size > 8 << 20:
                yield pd.DataFrame(block, columns=names)
                block, size = [], 0
        if block:
            yield pd.DataFrame(block, columns=names)

    def run(batches):
        def rows():
            now, before = None, None
            for batch in batches:
                for known, conv, *this, seen, ends in zip(*[batch[c].tolist() for c in batch.columns]):
                    if now is None or now.key != (known, conv):
                        if now is not None:
                            yield from now.repaired()
                        now, before = _Conversation((known, conv), limit), None
                    fault = BLANK if ends == 0 else DUPLICATE if seen or this == before else 0
                    if not fault and ends == 2:
                        fault = TRUNCATED
                    now.add((*this, fault))
                    before = this
            if now is not None:
                yield from now.repaired()

        yield from frames(rows())

    return run


def prepared(turns: DataFrame) -> DataFrame:
    """(known, conv, turn_known, turn, role, text) without nulls from conv_id, turn, role, text."""
    conv, turn = named("conv_id"), named("turn")
    return turns.select(
        conv.isNotNull().alias("known"),
        F.coalesce(conv.cast("long"), F.lit(0)).alias("conv"),
        turn.isNotNull().alias("turn_known"),
        F.coalesce(turn.cast("long"), F.lit(0)).alias("turn"),
        F.coalesce(named("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(named("text"), F.lit(" ")).alias("text"),
    )


def repair(rows: DataFrame, limit: int = HELD) -> DataFrame:
    """The rows of ``prepared`` and those put in, in order inside each conversation, as REPAIRED.

    A deleted row keeps its place with edit D. The order holds in the partitions that this returns, so a
    next step can stream on. Where a role and text stand again in their conversation is found by a
    grouping, not by a task that remembers a conversation.
    """
    group = ["known", "conv", "role", "mark"]
    marked = rows.withColumn("mark", F.sha2("text", 256))
    repeated = (
        marked.groupBy(*group)
        .agg(F.min(F.struct("turn_known", "turn")).alias("first"), F.count("*").alias("m"))
        .where("m > 1")
        .drop("m")
    )
    # what ends a text: 0 nothing but blanks, 1 a full stop, 2 anything else
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    ends = F.when(last == "", 0).when(last.isin(".", "!", "?"), 1).otherwise(2)
    here = F.struct("turn_known", "turn")
    streams = (
        marked.join(repeated, group, "left")
        .select(
            *rows.columns,
            F.coalesce(here != F.col("first"), F.lit(False)).alias("seen"),
            ends.alias("ends"),
        )
        .repartition("known", "conv")
        .sortWithinPartitions("known", "conv", "turn_known", "turn", "role", "text")
    )
    return streams.mapInPandas(_stream(limit), REPAIRED)


class _Summary:
    """What is reported of one conversation, added up row by row."""

    def __init__(self, key):
        self.key, self.faults, self.edits, self.sha = key, dict.fromkeys(FAULTS, 0), [], hashlib.sha256()
        self.low = self.high = self.initial = None
        self.distinct = self.illegal = self.cost = 0
        self.between = b""

    def add(self, turn_known, turn, old, fault, edit, role, text):
        self.faults[fault] += 1
        self.edits.append(edit)
        self.cost += _COSTS[edit] + (edit != "D" and fault == "truncated")
        if edit != "D":
            self.sha.update(self.between + f"{role}:{text}".encode())
            self.between = b"\n"
        if edit == "I":
            return
        if self.initial is not None:
            self.illegal += self.initial + old[:1] not in ("su", "ua", "au")
        self.initial = old[:1]
        if turn_known:
            self.low = turn if self.low is None else self.low
            self.distinct += turn != self.high
            self.high = turn

    def row(self):
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        faults = [self.faults[f] for f in FAULTS[1:]]
        return *self.key, gaps, *faults, self.illegal, self.cost, "".join(self.edits), self.sha.hexdigest()


def _digest(batches):
    """One row per conversation from repaired rows in order, with sums carried across batches."""
    names = [field.split()[0] for field in _DIGEST.split(",")]
    now, block = None, []
    for batch in batches:
        for known, conv, *row in zip(*[batch[c].tolist() for c in batch.columns]):
            if now is None or now.key != (known, conv):
                if now is not None:
                    block.append(now.row())
                now = _Summary((known, conv))
            now.add(*row)
        if block:
            yield pd.DataFrame(block, columns=names)
            block = []
    if now is not None:
        yield pd.DataFrame([now.row()], columns=names)


_DIGEST = (
    "known boolean, conv long, gaps long, blank long, duplicate long, truncated long, illegal long,"
    " cost long, audit string, repaired_sha256 string"
)


def damaged(rows: DataFrame) -> DataFrame:
    """The rows of ``prepared`` after planted faults: dropped, emptied, cut short, repeated, given to the user."""
    label = F.concat_ws(
        ":",
        F.when(F.col("known"), F.col("conv").cast("string")).otherwise(" "),
        F.when(F.col("turn_known"), F.col("turn").cast("string")).otherwise(" "),
    )
    kind = F.crc32(label.cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace("text", "[.!?]", ""))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where(kind != 0).select(
        "known", "conv", "turn_known", "turn",
        F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        text.otherwise(F.col("text")).alias("text"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = prepared(table(spark, sf_dir, "conversations"))
    report = repair(damaged(given)).mapInPandas(_digest, _DIGEST)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        given.select("known", "conv").distinct()
        .join(report, ["known", "conv"], "left")
        .select(
            F.when(F.col("known"), F.col("conv")).alias("conv_id"),
            *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
        )
    )


QUERIES = {"op12_conversations": op12_conversations}
ORACLES: dict[str, str] = {}
