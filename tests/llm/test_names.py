"""Stages keep columns of any name, also of those that they use themselves."""

import pytest
from pyspark.sql import functions as F

from aeromosaic.llm import decontaminate, language, mixing, sharding, simhash

NAMES = [
    "__rejected", "__lang", "__score", "__n_words", "__words_0", "__items", "__p_0", "__n_tokens", "__kept_fp",
    "__kept_id", "__fp", "fp", "__number", "__row", "__place", "hash", "root", "odd`name", "with.dot", "n_tokens",
]


@pytest.fixture(scope="module")
def docs(shipped):
    words = [f"w{k} and the other words of text number {k} are here" for k in range(12)]
    rows = [(k, words[k % 10], "en" if k % 2 else "fr") for k in range(12)] + [(None, None, None), (3, words[3], "en")]
    table = shipped.createDataFrame(rows, "doc_id long, text string, lang string")
    return table.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in NAMES])


def kept(table, docs):
    assert table.columns == docs.columns
    rows = table.collect()
    for row in rows:
        want = [None if row[0] is None else f"{n}:{row[0]}" for n in NAMES]
        assert list(row)[3:] == want
    return sorted((r[0] is not None, r[0] or 0) for r in rows)


def test_stages_keep_columns_of_any_name(shipped, docs):
    labels = shipped.createDataFrame([(k, 1, 0) for k in range(6)], "doc_id long, quality int, toxic int")
    benchmark = shipped.createDataFrame([(1, "w2 and the other words of text number 2 are here")], "item_id long, text string")
    kept(language.known_language(docs), docs)
    one = kept(simhash.one_of_each(docs), docs)
    assert len(one) == len(set(one)) and (True, 11) not in one
    clean = kept(decontaminate.clean(docs, benchmark), docs)
    assert (True, 2) not in clean and (True, 3) in clean
    assert len(kept(mixing.wanted_documents(docs, labels), docs)) == 14
    assert sharding.sharded(docs).count() == 14
