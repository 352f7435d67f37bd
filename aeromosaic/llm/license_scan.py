"""License scans: one automaton finds identifier tags and notice phrases, and a shunting-yard
parser evaluates and/or/with expressions.

Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased; a phrase is found
wherever its words stand one after the other. An expression runs from an identifier tag to the
end of its line; its names are looked up in the public list of identifiers, and one that isn't on it
lowers the score (0.3 for a tag of unknown names alone). NONE and NOASSERTION name no license. Null and empty texts have no words and no labels. Rows are scanned one by one,
so null ids, repeated rows and further columns change nothing; an empty table gives an empty
result. Texts are scanned whole, however long.
"""

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeromosaic.llm.texts import TO_WORDS, map_texts, table

# The phrases of the contract, then notices and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICES = {
    "apache license version 2 0": "apache-2.0",
    "apache license 2 0": "apache-2.0",
    "mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "isc license": "isc",
    "mozilla public license version 2 0": "mpl-2.0",
    "mozilla public license v 2 0": "mpl-2.0",
    "eclipse public license": "epl",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0-1.0",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0-1.0",
    "the unlicense": "unlicense",
    "boost software license": "bsl-1.0",
    "public domain": "public-domain",
    "proprietary and confidential": "proprietary",
}
TAG = "spdx license identifier"
# Identifiers of the public list of licenses by what they ask of a copy. Families stand
# for their versions: "gpl-2.0" for gpl-2.0, gpl-2.0+, gpl-2.0-only and gpl-2.0-or-later.
PERMISSIVE = """
0bsd aal afl-1.1 afl-1.2 afl-2.0 afl-2.1 afl-3.0 apache-1.0 apache-1.1 apache-2.0 artistic-2.0 blueoak-1.0.0
bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-4-clause bsl-1.0
cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc0-1.0 curl ecl-2.0 fsfap ftl hpnd ijg isc libpng
libpng-2.0 mit mit-0 mit-modern-variant mulanpsl-2.0 ncsa ntp openssl php-3.01 postgresql psf-2.0 python-2.0
ruby unicode-dfs-2016 unicode-3.0 unlicense upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1
""".split()
COPYLEFT = """
agpl-3.0 cc-by-sa-1.0 cc-by-sa-2.0 cc-by-sa-2.5 cc-by-sa-3.0 cc-by-sa-4.0 cddl-1.0 cddl-1.1 cecill-2.1 cpl-1.0
epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 gfdl-1.1 gfdl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0 gpl-3.0 lgpl-2.0 lgpl-2.1 lgpl-3.0
mpl-1.0 mpl-1.1 mpl-2.0 ms-pl ms-rl odbl-1.0 ofl-1.1 osl-3.0 qpl-1.0 sleepycat
""".split()
RESTRICTED = """
busl-1.1 cc-by-nc-1.0 cc-by-nc-2.0 cc-by-nc-2.5 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-nd-3.0 cc-by-nc-nd-4.0
cc-by-nc-sa-3.0 cc-by-nc-sa-4.0 cc-by-nd-3.0 cc-by-nd-4.0 elastic-2.0 json sspl-1.0
""".split()
EXCEPTIONS = """
autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 bootloader-exception classpath-exception-2.0
font-exception-2.0 gcc-exception-2.0 gcc-exception-3.1 gpl-cc-1.0 libtool-exception linux-syscall-note
llvm-exception openssl-exception qt-gpl-exception-1.0 u-boot-exception-2.0 universal-foss-exception-1.0
""".split()
CLASSES = {
    name: kind
    for kind, names in (("permissive", PERMISSIVE), ("copyleft", COPYLEFT), ("restricted", RESTRICTED), ("exception", EXCEPTIONS))
    for name in names
}
# Words that say that no license is named.
NONE = {"none", "noassertion"}
_TAG = re.compile(r"spdx[^0-9a-z\n]{0,3}license[^0-9a-z\n]{0,3}identifier[^0-9a-z(\n]*([^\n]*)", re.I | re.A)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
_RANK = {"or": 1, "and": 2, "with": 3}
# How sure a finding is, taken alone.
TAGGED, NOTICE, PHRASE, UNKNOWN = 1.0, 0.9, 0.6, 0.3


def license_class(name: str) -> str:
    """permissive, copyleft, restricted, exception, private (a name of the author's own), none or unknown."""
    if name in NONE:
        return "none"
    if name.startswith(("licenseref-", "documentref-")):
        return "private"
    plain = name.removesuffix("+").removesuffix("-only").removesuffix("-or-later")
    return CLASSES.get(name) or CLASSES.get(plain, "unknown")


def to_postfix(text: str) -> list[str] | None:
    """Shunting-yard: an expression in postfix order, as far as it is well-formed; None if it isn't."""
    out, stack, want = [], [], True
    for token in _TOKEN.findall(text):
        low = token.lower()
        if token == "(":
            if not want:
                break
            stack.append(token)
        elif token == ")":
            if want or "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif low in _RANK:
            if want:
                return None
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            want = True
        else:
            if not want:  # the expression is over; what follows is prose
                break
            out.append(low.rstrip(".:"))
            want = False
    if want or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(postfix: list[str]) -> tuple[set[str], bool]:
    """Identifiers of an expression, and whether permissive licenses alone satisfy it.

    ``or`` needs one side, ``and`` both, and an exception (``with``) never takes rights away. Names
    that are not on the list are not permissive.
    """
    stack: list[tuple[set[str], bool]] = []
    for token in postfix:
        if token not in _RANK:
            stack.append(({token}, license_class(token) == "permissive"))
            continue
        b, a = stack.pop(), stack.pop()
        holds = {"or": a[1] or b[1], "and": a[1] and b[1], "with": a[1]}[token]
        stack.append((a[0] | b[0], holds))
    return stack[0]


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in {**BASE, **NOTICES, TAG: ""}:
        # one space on each side, so that it ends and begins with whole words
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(text: str | None, automaton) -> dict:
    """Words, places and labels of one text."""
    words = (text or "").encode().translate(TO_WORDS).split()
    line = f" {b' '.join(words).decode('latin-1')} "
    places, labels, expressions, sure = [], set(), [], 0.0
    tagged, at, spaces = False, 0, 0
    hits = sorted((end - len(phrase) - 1, phrase) for end, phrase in automaton.iter(line))
    for start, phrase in hits:  # start: of the space before the phrase
        spaces += line.count(" ", at, start)
        at = start
        if phrase in BASE:
            places.append(spaces)
        label = BASE.get(phrase) or NOTICES.get(phrase)
        if label:
            labels.add(label)
            sure = max(sure, NOTICE if phrase in NOTICES else PHRASE)
        tagged = tagged or phrase == TAG
    base = {BASE[p] for _, p in hits if p in BASE}
    permissive = None
    if tagged:
        for m in _TAG.finditer(text):
            postfix = to_postfix(m[1])
            if postfix:
                names, open_ = evaluate(postfix)
                kinds = {n: license_class(n) for n in names if n}
                named = {n for n, kind in kinds.items() if kind != "none"}
                if not named:
                    continue
                labels |= named
                permissive = open_ if permissive is None else permissive and open_
                expressions.append(" ".join(postfix))
                sure = max(sure, UNKNOWN if "unknown" in kinds.values() else TAGGED)
    return {
        "n_words": len(words), "places": places, "base_labels": sorted(base), "labels": sorted(labels),
        "expressions": expressions, "permissive": permissive, "score": sure,
    }


_DDL = (
    "n_words long, places array<long>, base_labels array<string>, labels array<string>, "
    "expressions array<string>, permissive boolean, score double"
)
_TYPES = {
    "n_words": pa.int64(), "places": pa.list_(pa.int64()), "base_labels": pa.list_(pa.string()),
    "labels": pa.list_(pa.string()), "expressions": pa.list_(pa.string()), "permissive": pa.bool_(),
    "score": pa.float64(),
}


def license_scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, word starts of the base phrases, labels, parsed expressions and a score."""

    def start():
        automaton = _automaton()

        def work(column):
            rows = [scan(text, automaton) for text in column.to_pylist()]
            return [pa.array([r[k] for r in rows], t) for k, t in _TYPES.items()]

        return work

    return map_texts(docs, keep, _DDL, start)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"), ["doc_id"])
    some = F.size("places") > 0
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.when(some, F.array_min("places")).alias("first_word"),
        F.when(some, F.array_max("places")).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
        "permissive",
    )


QUERIES = {"op6_license_scan": op6_license_scan}
ORACLES: dict[str, str] = {}
