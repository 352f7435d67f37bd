"""Packing of documents into sequences of at most a window of tokens, in the order of the table.

The documents of a partition form one stream of ids, each document closed by an end id. The stream
is cut into windows; a window costs its padding up to ``window`` (none where its length is a power
of two), one for the sequence itself, and a penalty for the place where it ends: none at the end of
a document, SENTENCE at the end of a sentence, INSIDE elsewhere. Places inside sentences are open only
every STRIDE ids, so that a long run without a sentence end can be cut too. Dynamic programming
finds the cheapest cuts of a run of about RUN ids: the padded transitions come from a monotone queue
over the last ``window`` ids, the unpadded ones from the places a power of two behind. A run ends at
the end of a document, or inside one that is longer than a run, so memory is bounded by a run and the
longest text. Nothing is shuffled; a retried task makes the same rows.

A null or empty text is its end id alone. Repeated rows, null ids and further columns change nothing,
an empty table gives an empty result.
"""

import functools
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from aeromosaic.llm.texts import field_list, named, table
from aeromosaic.llm.token_counts import byte_letters

TOKENIZER = "word_bpe_49k.json"
WINDOW, END_ID = 4096, 2
SENTENCE, INSIDE, STRIDE = 4, 32, 64
PIECES = 1 << 18  # pieces that are looked up together
RUN = 1 << 18  # ids whose cuts are chosen together
MEMORY = 192 << 20  # bytes of pieces and ids a task remembers before it starts afresh

# How the tokenizer file takes lower-cased Latin-1 text apart, checked against its pattern.
_LETTER, _NUMBER, _BLANK = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The same as bytes; a run of other characters takes the blank after it along, to tell where sentences end.
_WORD = re.compile(
    f"'(?:s|t|re|ve|m|ll|d)|[{_LETTER}]+|[{_NUMBER}]|[^{_BLANK}{_LETTER}{_NUMBER}]+[ \t\n\r]?".encode("latin-1")
)
# Any other text is taken apart at white space alone, which the tokenizer drops.
_PIECE = re.compile(r"[^ \t\n\r]+")
_STOP = re.compile(rb"[.!?][\"')\]]*$")
_ADDED = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class _Numbers(dict):
    """Numbers of pieces in order of their first lookup; ``new`` has those not encoded yet."""

    def __init__(self):
        self.new = []

    def __missing__(self, piece):
        self.new.append(piece)
        number = self[piece] = len(self)
        return number


class Encoder:
    """Ids of texts from the ids of their pieces; a piece met again is not encoded again.

    Pieces are used where the file says that it drops white space and splits by the pattern above;
    other tokenizers encode whole texts, without places of sentences.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        steps = (config.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        normal = (config.get("normalizer") or {}).get("normalizers", [])
        self.by_piece = (
            steps[0].get("behavior") == "Removed"
            and steps[0].get("invert") is True
            and steps[0].get("pattern") == {"Regex": _PATTERN}
            and [s.get("type") for s in steps[1:]] == ["ByteLevel"]
            and [s.get("type") for s in normal] == ["NFC", "Replace", "Lowercase"]
        )
        self.added = [t["content"] for t in config.get("added_tokens") or []]
        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.merge, self.letters = self.model.model.tokenize, byte_letters()
        self._forget()

    def _forget(self):
        self.known, self.bytes, self.used = _Numbers(), 0, 0
        self.ids = np.zeros(1 << 16, np.uint32)
        self.first, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.stop = np.zeros(1 << 12, bool)

    def _encoded(self, piece: bytes) -> list[int]:
        """Ids of a word, which the merges take as it is, or of a piece of any text."""
        if piece[0] == 0x20:
            return self.model.encode(piece[1:].decode(), add_special_tokens=False).ids
        word = piece.rstrip(b" \t\n\r")
        if not word.isascii():
            word = word.decode("latin-1").encode()
        return [t.id for t in self.merge(word.decode("latin-1").translate(self.letters))]

    def _learn(self):
        pieces, self.known.new = self.known.new, []
        found = [self._encoded(p) for p in pieces]
        count, sizes = len(self.known) - len(pieces), [len(ids) for ids in found]
        end = self.used + sum(sizes)
        self.ids = _room(self.ids, end)
        self.ids[self.used : end] = [x for ids in found for x in ids]
        new = slice(count, count + len(pieces))
        self.first, self.size, self.stop = (
            _room(array, new.stop) for array in (self.first, self.size, self.stop)
        )
        self.size[new] = sizes
        self.first[new] = self.used + np.cumsum(sizes) - sizes
        self.stop[new] = [_ends_sentence(p) for p in pieces]
        self.used = end
        self.bytes += sum(map(len, pieces)) + 4 * sum(sizes) + 200 * len(pieces)

    def _taken_apart(self, text: str) -> list[bytes]:
        """Words of a text in Latin-1, else pieces between white space, in UTF-8 behind a space."""
        if not any(t in text for t in self.added):
            try:
                return _WORD.findall(text.lower().encode("latin-1"))
            except UnicodeEncodeError:
                pass
        return [b" " + piece.encode() for piece in _PIECE.findall(text)]

    def encode(self, texts: pa.Array):
        """The ids of each text, and the places after which a sentence ends, rising."""
        if not self.by_piece:
            for text in texts:
                ids = self.model.encode(text.as_py() or "", add_special_tokens=False).ids
                yield np.array(ids, np.uint32), np.zeros(0, np.int64)
            return
        group, bounds = [], [0]
        for k in range(len(texts)):
            group += self._taken_apart(texts[k].as_py() or "")
            bounds.append(len(group))
            if len(group) > PIECES or k + 1 == len(texts):
                yield from self._group(group, bounds)
                group, bounds = [], [0]

    def _group(self, pieces: list[bytes], bounds: list[int]):
        if self.bytes > MEMORY:
            self._forget()
        coded = pa.array(pieces, pa.binary()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        numbers = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        if self.known.new:
            self._learn()
        numbers = numbers[coded.indices.to_numpy()]
        for a, b in zip(bounds, bounds[1:]):
            number = numbers[a:b]
            sizes = self.size[number]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            places = np.repeat(self.first[number] - ends + sizes, sizes) + np.arange(total)
            yield self.ids[places], ends[self.stop[number]]


def _ends_sentence(piece: bytes) -> bool:
    """Whether a piece, or a word with the blank behind it, closes a sentence."""
    if piece[0] != 0x20 and piece[-1] not in b" \t\n\r":
        return False
    return _STOP.search(piece.rstrip(b" \t\n\r")) is not None


@functools.cache
def _encoder(path: str) -> Encoder:
    """What this worker has learnt, kept between its tasks."""
    return Encoder(path)


def _room(array: np.ndarray, size: int) -> np.ndarray:
    """The array, or a longer copy that has room for ``size`` entries."""
    if size <= len(array):
        return array
    more = np.zeros(max(size, 2 * len(array)) - len(array), array.dtype)
    return np.concatenate([array, more])


def places_to_cut(n: int, sentences: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Places 1..n of a document where a window may end, in order, and their penalties.

    ``sentences`` rises from above 0. The place before the end id is left out; gaps of more than ``stride`` ids are filled.
    """
    marks = sentences[: np.searchsorted(sentences, n - 1)]
    steps = np.concatenate([[0], marks, [n]])
    gaps = (np.diff(steps) - 1) // stride
    places, cost = steps[1:], np.full(len(marks) + 1, SENTENCE)
    cost[-1] = 0
    if gaps.any():
        wide = np.nonzero(gaps)[0]
        gaps = gaps[wide]
        turn = np.arange(gaps.sum()) - np.repeat(np.cumsum(gaps) - gaps, gaps) + 1
        inner = np.repeat(steps[wide], gaps) + stride * turn
        where = np.repeat(wide, gaps)
        places, cost = np.insert(places, where, inner), np.insert(cost, where, INSIDE)
    return places, cost


def cheapest_cuts(places: np.ndarray, penalties: np.ndarray, window: int = WINDOW) -> tuple[list[int], int]:
    """Ends of the cheapest windows over 0 < places[0] < places[1] < ..., the last of which is an end.

    No two neighbours are more than ``window`` apart. Among equally cheap ways the earliest
    start of the last window wins, so sequences are few.
    """
    pos = np.concatenate([[0], places])
    at = np.full(int(pos[-1]) + 1, -1, np.int64)
    at[pos] = np.arange(len(pos))
    later, earlier = [], []
    power = 1
    while power <= window:
        some = np.nonzero(pos >= power)[0]
        found = at[pos[some] - power]
        later.append(some[found >= 0])
        earlier.append(found[found >= 0])
        power *= 2
    later, earlier = np.concatenate(later), np.concatenate(earlier)
    order = np.lexsort((earlier, later))
    earlier = earlier[order].tolist()
    bounds = np.searchsorted(later[order], np.arange(len(pos) + 1)).tolist()
    pos, extra = pos.tolist(), [0, *(penalties + 1).tolist()]
    cost, back = [0] * len(pos), [0] * len(pos)
    queue, head = [(0, 0, 0)], 0  # (cost + place, place, number), costs rising
    for i in range(1, len(pos)):
        p = pos[i]
        while queue[head][1] < p - window:
            head += 1
        best, _, came = queue[head]
        best += window - p
        for j in earlier[bounds[i] : bounds[i + 1]]:
            if cost[j] < best or cost[j] == best and j < came:
                best, came = cost[j], j
        cost[i], back[i] = best + extra[i], came
        own = cost[i] + p
        while len(queue) > head and queue[-1][0] > own:
            queue.pop()
        queue.append((own, p, i))
    cuts, i = [], len(pos) - 1
    while i:
        cuts.append(pos[i])
        i = back[i]
    return cuts[::-1], cost[-1]


def padding(length, window: int = WINDOW):
    """Ids added to a sequence of this length."""
    return 0 if length & (length - 1) == 0 else window - length


class _Run:
    """Documents, or parts of one, whose ids are cut together."""

    def __init__(self):
        self.rows, self.starts, self.totals, self.ids, self.places, self.costs = [], [], [], [], [], []
        self.size = 0

    def add(self, row, start, total, ids, places, costs):
        self.rows.append(row)
        self.starts.append(start)
        self.totals.append(total)
        self.ids.append(ids)
        self.places.append(places + self.size)
        self.costs.append(costs)
        self.size += len(ids)


def _pieces(run: _Run, window: int, sequence: int):
    """Arrow arrays of the pieces of a run, the row each is of, and the number of sequences."""
    cuts, _ = cheapest_cuts(np.concatenate(run.places), np.concatenate(run.costs), window)
    flat = np.ascontiguousarray(np.concatenate(run.ids), "<u4")
    docs = np.concatenate([[0], np.cumsum([len(x) for x in run.ids])[:-1]])
    sequences = np.concatenate([[0], cuts[:-1]]).astype(np.int64)
    begin = np.union1d(docs, sequences)
    end = np.append(begin[1:], run.size)
    doc = np.searchsorted(docs, begin, "right") - 1
    seq = np.searchsorted(sequences, begin, "right") - 1
    offsets = pa.py_buffer((np.append(begin, run.size) * 4).astype(np.int32))
    ids = pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, offsets, pa.py_buffer(flat)])
    columns = [
        pa.array(np.array(run.starts, np.int64)[doc] + begin - docs[doc]),
        pa.array(end - begin),
        ids,
        pa.array(np.array(run.totals, np.int64)[doc]),
        pa.array(sequence + seq),
        pa.array(begin - sequences[seq]),
    ]
    return columns, np.array(run.rows)[doc], len(cuts)


def pack(
    docs: DataFrame,
    keep: list[str],
    tokenizer: str = TOKENIZER,
    window: int = WINDOW,
    end_id: int = END_ID,
    run_ids: int = RUN,
) -> DataFrame:
    """One row per piece of a document: ``keep`` columns, start, length, ids (little-endian uint32),
    doc_tokens, sequence_id and offset. ``window`` is at most ``run_ids``.
    """
    wanted = [*keep, "text"]
    schema = StructType([docs.schema[c] for c in keep] + field_list(_ADDED).fields)
    names = schema.names

    def run(batches):
        import public_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _encoder(tokenizer if os.sep in tokenizer else public_tokenizers.path(tokenizer))
        sequence = TaskContext.get().partitionId() << 33
        held, rows, now = [], 0, _Run()

        def close():
            nonlocal held, rows, now, sequence
            made, row, n = _pieces(now, window, sequence)
            kept = pa.Table.from_batches(held).take(pa.array(row)).combine_chunks()
            out = pa.Table.from_arrays([*kept.columns, *made], names=names).to_batches(max_chunksize=8192)
            held, rows, now, sequence = held[-1:], len(held[-1]) if held else 0, _Run(), sequence + n
            return out

        for batch in batches:
            texts = batch.column(len(keep))
            kept = pa.RecordBatch.from_arrays(batch.columns[: len(keep)], names[: len(keep)])
            held.append(kept)
            base, rows = rows, rows + len(kept)
            for k, (ids, sentences) in enumerate(encoder.encode(texts)):
                ids = np.append(ids, np.uint32(end_id))
                places, costs = places_to_cut(len(ids), sentences)
                done = 0
                while now.size + len(ids) - done > run_ids:
                    # as many whole places as the run has room for; a run that has some closes first
                    room = np.searchsorted(places, done + run_ids - now.size, "right")
                    first = np.searchsorted(places, done, "right")
                    if len(ids) > run_ids and room > first:
                        stop = int(places[room - 1])
                        part = slice(first, room)
                        now.add(base + k, done, len(ids), ids[done:stop], places[part] - done, costs[part])
                        done = stop
                    if now.size:
                        yield from close()
                        base = rows - len(kept)
                first = np.searchsorted(places, done, "right")
                if done < len(ids):
                    now.add(base + k, done, len(ids), ids[done:], places[first:] - done, costs[first:])
        if now.size:
            yield from close()

    return docs.select(*[named(c) for c in wanted]).mapInArrow(run, schema)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), ["doc_id"])
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


QUERIES = {"op11_packing": op11_packing}
ORACLES: dict[str, str] = {}
