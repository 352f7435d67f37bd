"""Token counts: batch encoding in Arrow functions that return lengths only.

Long texts are cut at safe boundaries (a byte-level tokenizer never makes a token across
the place where a character that is no white space is followed by a space or line feed),
pieces are encoded by the library in batches of about the same number of bytes, and a
piece met again in the same task is not encoded twice. Null and empty texts have 0 tokens;
rows are counted one by one, so repeated rows, null ids and further columns change nothing;
an empty table gives an empty result.
"""

import functools
import json
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from aeromosaic.llm.texts import map_texts, table

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
BATCH_BYTES = 256 << 10  # bytes that one call of the library encodes
SEGMENT = 1 << 20  # characters of a text that are taken apart at once
MEMORY = 1_500_000  # pieces that a worker remembers before it starts afresh

_ENDS = ".,;:!?%*&$#)"
_SAFE = re.compile(r"(?<=\S)(?=[ \n])")
# One word of the byte-level pattern whatever stands around it: letters of the Latin blocks.
_WORD = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
_PIECE = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")


def _load(path: str):
    """The library's encoder of a batch of texts, and whether texts may be cut."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: map(len, model.encode(texts, num_threads=1)), False
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    before = config.get("pre_tokenizer") or {}
    byte_level = before.get("type") == "ByteLevel" and before.get("use_regex", True)
    plain = not before.get("add_prefix_space") and not config.get("normalizer")
    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    letters, merge = byte_letters(), model.model.tokenize

    def encode(texts):
        """Lengths; a word on its own goes to the merges without being taken apart again."""
        if not (byte_level and plain):
            return map(len, model.encode_batch_fast(texts, add_special_tokens=False))
        other = [t for t in texts if not _WORD.fullmatch(t)]
        sizes = dict(
            zip(other, map(len, model.encode_batch_fast(other, add_special_tokens=False)), strict=True)
        )
        return [
            sizes[t] if t in sizes else len(merge(t.encode().decode("latin-1").translate(letters)))
            for t in texts
        ]

    return encode, bool(byte_level and plain)


def byte_letters() -> dict[int, str]:
    """The letter a byte-level vocabulary writes for each byte: itself if it prints, else from 256 on."""
    prints = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(256 + n) for n, b in enumerate(rest)}


def segments(text: str, size: int = SEGMENT):
    """Consecutive parts of a text, cut at safe boundaries at or after every ``size`` characters."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def _cut(texts):
    """(row, part) of every part of every text."""
    for row, text in enumerate(texts):
        for part in segments(text or ""):
            yield row, part


def balanced(pieces, limit: int = BATCH_BYTES):
    """Lists of texts, or of (row, text), of about ``limit`` characters each."""
    batch, size = [], 0
    for piece in pieces:
        batch.append(piece)
        size += len(piece if isinstance(piece, str) else piece[1]) + 8
        if size >= limit:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def halves(piece: str) -> tuple[str, str]:
    """A piece cut before its last punctuation, if that follows a letter or digit: safe as well."""
    word = piece.rstrip(_ENDS)
    return (word, piece[len(word) :]) if word and word[-1].isalnum() else (piece, "")


@functools.cache
def _memory(path: str) -> dict[str, int]:
    """What this worker has counted already, kept between its tasks."""
    return {"": 0}


def _counter(tokenizer: str):
    def start():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers

        path = tokenizer if os.sep in tokenizer else public_tokenizers.path(tokenizer)
        encode, may_cut = _load(path)
        seen = _memory(path)

        def learn(pieces):
            """Remember the pieces not seen so far, encoded in balanced batches."""
            cut = {p: halves(p) for p in pieces}
            parts = {x for pair in cut.values() for x in pair}.difference(seen)
            for batch in balanced(parts):
                seen.update(zip(batch, encode(batch), strict=True))
            seen.update((p, seen[a] + seen[b]) for p, (a, b) in cut.items() if b)

        def count_cut(texts):
            for group in balanced(_cut(texts), SEGMENT):
                found = [(row, _PIECE.findall(part)) for row, part in group]
                if len(seen) > MEMORY:
                    seen.clear()
                    seen[""] = 0
                learn(set().union(*[pieces for _, pieces in found]).difference(seen))
                for row, pieces in found:
                    yield row, sum(map(seen.__getitem__, pieces))

        def count_whole(texts):
            for batch in balanced([t or "" for t in texts]):
                yield from encode(batch)

        def work(column):
            texts = column.to_pylist()
            if not may_cut:
                return [pa.array(list(count_whole(texts)), pa.int64())]
            totals = [0] * len(texts)
            for row, n in count_cut(texts):
                totals[row] += n
            return [pa.array(totals, pa.int64())]

        return work

    return start


def token_counts(
    docs: DataFrame, keep: list[str], tokenizer: str = TOKENIZER, limit: int = LIMIT
) -> DataFrame:
    """``keep`` columns, n_bytes, n_tokens and over_limit of every whole text.

    ``tokenizer`` is a file of the public tokenizers, or a path that workers can open.
    """
    count = _counter(tokenizer)

    def start():
        work = count()

        def both(column):
            (tokens,) = work(column)
            size = pc.fill_null(pc.binary_length(column.cast(pa.binary())), 0)
            return [size.cast(pa.int64()), tokens, pc.greater(tokens, limit)]

        return both

    return map_texts(docs, keep, "n_bytes long, n_tokens long, over_limit boolean", start)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), ["doc_id"])


QUERIES = {"op3_token_counts": op3_token_counts}
ORACLES: dict[str, str] = {}
