"""Mixing where unwanted text is common, rare and very rare."""

import numpy as np
import pytest

from aeromosaic.llm import mixing
from odd import documents


@pytest.mark.parametrize("toxic", [800, 80, 8])
def test_planted_toxic_documents_go_and_clean_ones_stay(shipped, toxic):
    rng, clean = np.random.default_rng(toxic), 8000 - toxic
    plain, bad = [f"word{k}" for k in range(60)], [f"slur{k}" for k in range(6)]
    rows = [(k, " ".join(rng.choice(plain, 12)), "en") for k in range(clean)]
    rows += [(k, " ".join([*rng.choice(plain, 6), *bad]), "en") for k in range(clean, 8000)]
    # every third clean document of low quality, a tenth without a label
    labels = [(k, int(k % 3 > 0), int(k >= clean)) for k, _, _ in rows if k >= clean or k % 10]
    labels = shipped.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in mixing.wanted_documents(documents(shipped, rows), labels).select("doc_id").collect()}
    assert not [k for k in kept if k >= clean]
    assert len(kept) == clean


def test_memberships(shipped):
    rows = [(0.7, 0.2, 0.1), (0.3, 0.25, 0.45), (0.2, 0.2, 0.6), (0.1, 0.4, 0.5), (0.4, 0.4, 0.2)]
    table = shipped.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, a double, b double, c double")
    one = mixing.memberships([mixing.F.col(c) for c in "abc"], mixing.NATURAL)
    found = table.orderBy("k").select(*[x.alias(f"p_{k}") for k, x in enumerate(one)]).collect()
    assert [tuple(r).index(1.0) for r in found] == [0, 0, 2, 1, 0] and {sum(r) for r in found} == {1.0}


@pytest.mark.parametrize("mass", [0.1, 0.002, 1e-5])
@pytest.mark.parametrize("targets", [mixing.TARGETS, mixing.NATURAL])
def test_rates_meet_the_condition_of_the_optimum(shipped, mass, targets):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([3.0, 1.0, 0.05], 2000)
    p[:, 2] *= mass / p[:, 2].mean()
    p = np.minimum(p, 1) / np.minimum(p, 1).sum(1, keepdims=True)
    n = rng.integers(1, 2000, len(p))
    rows = [(int(a), *map(float, b)) for a, b in zip(n, p, strict=True)]
    scored = shipped.createDataFrame(rows, "n_tokens long, p_0 double, p_1 double, p_2 double")
    found = mixing.solve(scored, targets).collect()
    n, p, rate = (np.array([r["n_tokens"] for r in found], float), np.array([list(r)[1:4] for r in found]), np.array([r["rate"] for r in found]))
    natural = n @ p / n.sum()
    wanted = np.array(mixing.shares(targets, list(natural)))
    left = (n * rate) @ p / n.sum() - natural[:2].sum() * wanted
    assert np.abs(rate - np.maximum(0, 1 - p @ (left / natural) / mixing.PULL)).max() < 0.01


def test_rates_that_do_not_converge_are_told(shipped, monkeypatch):
    monkeypatch.setattr(mixing, "ROUNDS", 1)
    scored = shipped.createDataFrame([(9, 0.1, 0.2, 0.7), (9, 0.8, 0.2, 0.0)], "n_tokens long, p_0 double, p_1 double, p_2 double")
    with pytest.warns(UserWarning, match="relative residuals"):
        assert mixing.solve(scored, mixing.TARGETS).count() == 2


def _planted(docs, keep, model):
    """Posteriors that the texts tell: tokens and the three of them."""
    part = mixing.F.split("text", " ")
    made = [part[k + 1].cast("double").alias(f"__p_{k}") for k in range(3)]
    return docs.select(*keep, part[0].cast("long").alias("__n_tokens"), *made)


NEAR_HIGH, NEAR_LOW, PURE = 900, 901, 902


@pytest.mark.parametrize("overlap", [0, 1])
@pytest.mark.parametrize("targets", [mixing.NATURAL, {"high": 0.85, "low": 0.15, "toxic": 0.0}, {"high": 0.15, "low": 0.85, "toxic": 0.0}])
def test_solved_rates_decide_which_documents_stay(shipped, monkeypatch, overlap, targets):
    rng = np.random.default_rng(7)
    alpha = np.array([4.0, 4.0, 0.4])
    p = rng.dirichlet(alpha, 900)
    # unwanted text stands beside one of the wanted domains
    p[:300] = rng.dirichlet(np.array([6.0, 0.2, 5.0])[[overlap, 1 - overlap, 2]], 300)
    p = np.vstack([p, [0.46, 0.02, 0.52], [0.02, 0.46, 0.52], np.eye(3)])
    n = rng.integers(50, 2000, len(p))
    rows = [(k, " ".join([str(a), *map(repr, map(float, b))]), "en") for k, (a, b) in enumerate(zip(n, p, strict=True))]
    monkeypatch.setattr(mixing, "fit", lambda *_: None)
    monkeypatch.setattr(mixing, "posteriors", _planted)
    labels = shipped.createDataFrame([], "doc_id long, quality int, toxic int")
    found = mixing.wanted_documents(documents(shipped, rows), labels, targets)
    kept = {r["doc_id"] for r in found.select("doc_id").collect()}

    # the same problem by many plain steps; the last three documents are pure, so their rates are the domains'
    share = n @ p / n.sum()
    wanted = share[:2].sum() * np.array(mixing.shares(targets, list(share)))
    r = ahead = np.ones(len(n))
    for k in range(6000):
        left = ((n * ahead) @ p / n.sum() - wanted) / share
        new = np.maximum(0, ahead - (p @ left + mixing.PULL * (ahead - 1)) / (1 + mixing.PULL))
        ahead, r = new + (k / (k + 3) if k % 200 else 0) * (new - r), new
    mine = np.where(p[:, 2] > 0.5, 2, np.where(p[:, 1] > p[:, 0], 1, 0))
    whole = np.array([n[mine == k].sum() for k in (0, 1)])
    least = 0.5 * whole @ r[PURE : PURE + 2] / whole.sum()
    worth = p @ r[PURE:]
    sure = np.abs(worth - least) > 1e-3
    assert sure.sum() > 880
    assert {k for k in np.flatnonzero(sure & (worth > least))} == {k for k in kept if sure[k]}
    # of two documents as unwanted as each other, the one of the domain that is short may stay
    short = NEAR_HIGH if r[PURE] > r[PURE + 1] else NEAR_LOW
    assert short in kept and NEAR_HIGH + NEAR_LOW - short not in kept and PURE + 2 not in kept


def test_no_wanted_domain_or_no_tokens(shipped):
    labels = shipped.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents(shipped, [(1, "some words", "en"), (2, None, "en")])
    assert mixing.wanted_documents(docs, labels).count() == 2
    assert mixing.wanted_documents(docs, labels, dict.fromkeys(mixing.DOMAINS, 0.0)).count() == 0
    assert mixing.wanted_documents(docs.where("doc_id = 2"), labels).count() == 1
