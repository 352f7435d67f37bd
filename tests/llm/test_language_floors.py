"""Texts of unlearned languages beside odd training rows, and the sample of training texts."""

import numpy as np

from aeromosaic.llm import language
from odd import documents

ITALIAN = """Il mercato si tiene ogni sabato nella piazza vicino alla chiesa e gli abitanti comprano frutta,
verdura, pane e formaggio dai contadini della valle. Dopo pranzo i bambini giocano lungo il fiume mentre i nonni
parlano del tempo e della vendemmia che quest'anno promette molto bene. """
DUTCH = """De markt wordt elke zaterdag gehouden op het plein naast de kerk en de inwoners kopen fruit, groente,
brood en kaas van de boeren uit de vallei. Na het middageten spelen de kinderen langs de rivier terwijl de
grootouders praten over het weer en de oogst die dit jaar heel goed belooft te worden. """


def test_latin_script_of_an_unlearned_language_is_rejected(shipped, given):
    junk = [(2 * 10**6 + k, f"BE!! SCUM!! {k} zzz qqq xkcd " * 12, lang) for k, lang in enumerate(["en", "de", "es", "fr"])]
    rows = [*given, *junk, (10**6, ITALIAN, None), (10**6 + 1, DUTCH, None)]
    kept = {r["doc_id"] for r in language.known_language(documents(shipped, rows)).collect()}
    assert not kept & {10**6, 10**6 + 1}
    assert len(kept & {i for i, _, _ in given}) >= 0.99 * len(given)


def test_a_few_odd_rows_do_not_lower_a_floor():
    cosine, classes = np.linspace(0.8, 0.9, 100), np.full(100, 9)
    odd = language._floors(np.r_[cosine, 0.05, 0.1], np.r_[classes, 9, 9])
    assert abs(odd[9] - language._floors(cosine, classes)[9]) < 0.01


def test_the_sample_holds_distinct_texts_of_each_language(shipped):
    rows = [(1, "the same words", "en")] * 50 + [(k, f"other words {k}", "en") for k in range(2, 30)]
    rows += [(k, f"autres mots {k}", "fr") for k in range(40, 43)]
    got = [(r["lang"], r["text"]) for r in language._sample(documents(shipped, rows).select("doc_id", "text", "lang"), 20).collect()]
    assert len(got) == len(set(got)) == 23
