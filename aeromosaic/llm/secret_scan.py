"""Secret scans: patterns give candidates, structure confirms them before they are reported.

Plain kinds are ``assign`` (a value given to a password-like name), ``access`` (cloud access
keys) and ``hex`` (long hexadecimal runs). Confirmed kinds are decoded first: ``jwt`` (signed
tokens: the header is JSON naming an algorithm and the signature has that algorithm's length),
``der`` (base64 or hex of a private key whose nested lengths fill it exactly; base64 may be wrapped
into lines and may stand behind other text) and ``pem`` (the same between private-key lines, or the
length-prefixed format of SSH keys; line ends may be written as \\n and header lines may come first;
a body that those headers call encrypted has no structure to see and is confirmed by its cipher's
block size and initial vector).

Null and empty texts have no spans and the digest of the empty string. Rows are scanned one by
one, so null ids, repeated rows and further columns change nothing; an empty table gives an
empty result. A text is always scanned whole.
"""

import base64
import binascii
import json
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from aeromosaic.llm.texts import map_texts, sha256_join, table

KINDS = ["assign", "access", "hex", "jwt", "der", "pem"]
BASE = KINDS[:3]


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(
    [*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")]
)
_ASSIGN = rf"(?:{_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
# Runs are matched from their minimum length on: a run is as long as it can be, so a
# shorter one fails whole, as it does when matched first and measured after.
_ACCESS = r"AKIA[A-Z0-9]{14,}"
_HEX = r"[0-9a-f]{16,}"
_JWT = r"(?<![A-Za-z0-9_-])e[yw][A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]*"
# Line ends of a wrapped text, as they are or as other formats write them.
_BREAK = r"(?:\r\n|\n|\\r\\n|\\n)"
_RUN = r"[A-Za-z0-9+/_-]{40,}={0,2}"
_LINE = re.compile(rf"{_BREAK}([A-Za-z0-9+/]+)(={{0,2}})")
_HEADERS = rf"(?:[A-Za-z0-9-]+: [^\n\\]*{_BREAK})*"
_PEM = (
    rf"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----\s*+(?:{_BREAK})?({_HEADERS})"
    r"((?:[A-Za-z0-9+/=\s]++|\\[rn])++)-----END \1-----"
)
_FIND = {k: re.compile(p) for k, p in zip(KINDS, (_ASSIGN, _ACCESS, _HEX, _JWT, _RUN, _PEM), strict=True)}
# What a text must have for its kind to be looked for, told for a whole column at once.
_FIRST = {
    "assign": rf"(?:{_NAMES})[\"']?\x20*[:=]",
    "access": r"AKIA[A-Z0-9]",
    "hex": _HEX,
    "jwt": r"e[yw][A-Za-z0-9_-]{6}[A-Za-z0-9_-]*\.[A-Za-z0-9_-]{4}",
    "der": r"[A-Za-z0-9+/_-]{40}",
    "pem": r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----",
}
# Object identifiers of key encryption: 1.2.840.113549.1.5.x and 1.2.840.113549.1.12.1.x.
_ENCRYPTION = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
# Signature bytes of the algorithms of signed tokens (RSA: any from 128 on).
_SIGNED = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "EdDSA": 64}


def from_base64(text: str) -> bytes | None:
    """The bytes of base64 in either alphabet, padded or not; None if it isn't any."""
    core = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(core) % 4 == 1:
        return None
    try:
        return base64.b64decode(core + "=" * (-len(core) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _element(data: bytes, at: int, end: int):
    """(tag, start, stop) of the DER element at a place, or None."""
    if at + 2 > end:
        return None
    tag, size, start = data[at], data[at + 1], at + 2
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or start + n > end:
            return None
        size, start = int.from_bytes(data[start : start + n]), start + n
        if size < 0x80:  # not the shortest form
            return None
    return (tag, start, start + size) if start + size <= end else None


def _children(data: bytes, start: int, stop: int) -> list[tuple[int, int, int]] | None:
    found = []
    while start < stop:
        item = _element(data, start, stop)
        if item is None:
            return None
        found.append(item)
        start = item[2]
    return found


def is_private_key(data: bytes) -> bool:
    """Whether the bytes are a private key: every nested length fits and the parts are a key's."""
    top = _element(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    parts = _children(data, *top[1:])
    if not parts or len(parts) < 2:
        return False
    tags = [p[0] for p in parts]
    if tags == [0x30, 0x04]:  # encrypted: the identifier of a cipher, then the key under it
        inner = _children(data, *parts[0][1:])
        if not inner or inner[0][0] != 0x06 or parts[1][2] - parts[1][1] < 16:
            return False
        return data[inner[0][1] : inner[0][2]].startswith(_ENCRYPTION)
    version = data[parts[0][1] : parts[0][2]]
    if tags[0] != 0x02 or len(version) != 1 or version[0] > 1:
        return False
    if len(tags) == 9 and set(tags) == {0x02}:  # RSA: version and eight numbers
        return all(stop > start for _, start, stop in parts)
    if tags[:3] == [0x02, 0x30, 0x04]:  # any algorithm, its identifier first
        inner = _children(data, *parts[1][1:])
        return bool(inner) and inner[0][0] == 0x06 and parts[2][2] > parts[2][1]
    if tags[:2] == [0x02, 0x04] and version[0] == 1:  # elliptic curve
        return parts[1][2] - parts[1][1] in (20, 24, 28, 32, 48, 66)
    return len(tags) == 6 and set(tags) == {0x02}  # DSA


def is_ssh_key(data: bytes) -> bool:
    """Whether the bytes are an SSH private key: magic, three names and a count, then the keys."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)
    for part in range(5):
        if at + 4 > len(data):
            return False
        size = int.from_bytes(data[at : at + 4])
        at += 4
        if part == 3:  # number of keys
            if size != 1:
                return False
        elif at + size > len(data):
            return False
        else:
            at += size
    return True


def is_signed_token(text: str) -> bool:
    """Whether three dotted parts are a signed token."""
    header, body, signature = text.split(".")
    try:
        head, claims = (json.loads(from_base64(x) or b"") for x in (header, body))
    except (ValueError, UnicodeDecodeError):
        return False
    if not isinstance(head, dict) or not isinstance(claims, dict):
        return False
    alg, signed = head.get("alg"), from_base64(signature)
    if not isinstance(alg, str) or signed is None:
        return False
    if alg in _SIGNED:
        return len(signed) == _SIGNED[alg]
    return alg[:2] in ("RS", "PS") and len(signed) >= 128


def _declared(data: bytes) -> int:
    """Bytes of the DER sequence that data begins with; 0 if a key can't begin so.

    A key's first part is its version, a number of one byte, or the sequence that names a cipher.
    """
    if len(data) < 12 or data[0] != 0x30:
        return 0
    size, start = data[1], 2
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4:
            return 0
        size, start = int.from_bytes(data[2 : 2 + n]), 2 + n
    first = data[start : start + 3]
    return start + size if first[0] == 0x30 or first in (b"\2\1\0", b"\2\1\1") else 0


def _is_key(data: bytes | None) -> bool:
    return data is not None and (is_private_key(data) or is_ssh_key(data))


# Where a key may begin in a run: at its start, or behind a character that joins paths and names.
# Its first byte, a sequence or the SSH magic, is M or b in base64.
_BEGINS = re.compile(r"(?:^|(?<=[/_+-]))(?=M[A-I]|b3Bl)")


def _unwrapped(text: str) -> str:
    return re.sub(r"\s|\\[rn]", "", text)


def _key_at(text: str, start: int, stop: int) -> int | None:
    """Where the base64 key that begins at start ends: with its line, or some equal lines later.

    A DER key tells its length at its start, and must end just there; an SSH key ends with the
    first line of another length.
    """
    head = from_base64(text[start : min(stop, start + 20)].rstrip("=")[:20]) or b""
    need = -(-_declared(head) * 4 // 3)
    if not need and not head.startswith(b"openssh-key-v1"):
        return None
    core = text[start:stop].rstrip("=")
    width, parts, held = stop - start, [core], len(core)
    while (held < need or not need) and len(parts[-1]) == width and (line := _LINE.match(text, stop)):
        if len(line[1]) > width:
            break
        parts.append(line[1])
        held += len(line[1])
        stop = line.end()
    if need and held != need:
        return None
    return stop if _is_key(from_base64("".join(parts))) else None


def _key_run(m: re.Match) -> tuple[int, int] | None:
    """The span of a private key in or from a run of base64 or hex; None without one."""
    text, run, at = m.string, m[0], m.start()
    if len(run) >= 64 and len(run) % 2 == 0 and re.fullmatch(r"[0-9a-fA-F]+", run):
        if is_private_key(bytes.fromhex(run)):
            return m.span()
    begins = [at + b.start() for b in _BEGINS.finditer(run)]
    if run[0] in "rn" and text[at - 1 : at] == "\\":  # the run's first character ends a written line end
        begins.insert(0, at + 1)
    for start in begins:
        stop = _key_at(text, start, m.end())
        if stop:
            return start, stop
    return None


def _pem_block(headers: str, body: str) -> bool:
    data = from_base64(_unwrapped(body))
    if data is None or not data:
        return False
    cipher = re.search(r"DEK-Info: ([A-Z0-9-]+),([0-9A-Fa-f]+)", headers)
    if cipher and "ENCRYPTED" in headers:
        block = len(cipher[2]) // 2
        return block in (8, 16) and len(data) % block == 0
    return _is_key(data)


# The span that a match stands for; None drops it.
_SPAN = {
    "assign": lambda m: m.span() if len(m[1]) >= 12 else None,
    "access": lambda m: m.span(),
    "hex": lambda m: m.span(),
    "jwt": lambda m: m.span() if is_signed_token(m[0]) else None,
    "der": _key_run,
    "pem": lambda m: m.span() if _pem_block(m[2], m[3]) else None,
}


def find(text: str, kinds=KINDS) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the spans of a text, by start and then kind as listed."""
    spans = []
    for k in kinds:
        found = filter(None, map(_SPAN[k], _FIND[k].finditer(text)))
        spans += [(start, KINDS.index(k), end) for start, end in found]
    return [(start, end, KINDS[k]) for start, k, end in sorted(spans)]


_SPANS = "spans array<struct<kind:string,start:int,end:int>>"


def secret_spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and the spans of every whole text (code points, end exclusive)."""

    def start():
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

        def work(column):
            some = {k: pc.match_substring_regex(column, p).to_pylist() for k, p in _FIRST.items()}
            rows = []
            for row in range(len(column)):
                kinds = [k for k in KINDS if some[k][row]]
                found = find(column[row].as_py(), kinds) if kinds else []
                rows.append([{"kind": k, "start": a, "end": b} for a, b, k in found])
            return [pa.array(rows, kind)]

        return work

    return map_texts(docs, keep, _SPANS, start)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and list of the spans that secret_spans reports."""
    found = secret_spans(table(spark, sf_dir, "documents"), ["doc_id"])

    def digest(batches):
        for batch in batches:
            out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
            for spans in batch.column(1).to_pylist():
                for k in BASE:
                    out[f"n_{k}"].append(sum(s["kind"] == k for s in spans))
                texts = [(s["kind"], f"{s['kind']}:{s['start']}:{s['end']}") for s in spans]
                out["base_sha256"].append(sha256_join([x for k, x in texts if k in BASE]))
                out["spans"].append(",".join(x for _, x in texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(v, pa.int64()) for v in list(out.values())[:3]],
                 *[pa.array(v, pa.string()) for v in list(out.values())[3:]]],
                ["doc_id", *out],
            )

    doc_id = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(
        digest,
        f"doc_id {doc_id}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string",
    )


QUERIES = {"op2_secret_scan": op2_secret_scan}
ORACLES: dict[str, str] = {}
