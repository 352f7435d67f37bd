"""Neighbours, fingerprints, languages, mixing, shards and language-model scores against plain versions."""

import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from aeromosaic.llm import components, language, mixing, neighbours, ppm, sharding, simhash
from odd import ODD, SF_DIR, documents

LOWER = {c: c + 32 for c in range(65, 91)}


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


# ---- neighbours


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


def test_neighbours_find_nearly_all(shipped):
    rows = shipped.read.parquet(os.path.join(SF_DIR, "embeddings.parquet")).collect()
    ids = np.array([r["vec_id"] for r in rows])
    v = np.array([r["embedding"] for r in rows], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    found = defaultdict(dict)
    for r in neighbours.op1_neighbours(shipped, SF_DIR).collect():
        found[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    queries = np.flatnonzero(ids % 50 == 0)
    hits = 0
    for q in queries:
        scores = v @ v[q]
        scores[q] = -2
        best = set(ids[np.lexsort((ids, -scores))[:5]])
        got = found[ids[q]]
        assert sorted(got) == [1, 2, 3, 4, 5]
        assert all(abs(scores[ids == i][0] - s) < 1e-12 for i, s in got.values())
        hits += len(best & {i for i, _ in got.values()})
    assert hits >= 0.9 * 5 * len(queries)


def test_neighbours_of_copies_and_odd_rows(shipped, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 16)  # several cells
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=4).tolist(), "s") for k in range(100, 160)]
    rows += [(k, [1.0, 2.0, 3.0, 4.0], "s") for k in range(0, 90)]
    rows += [(200, None, "s"), (250, [0.0] * 4, "s"), (300, [1.0, None, 0.0, 0.0], "s"), (350, [1.0], "s")]
    rows += [(400, [float("nan")] * 4, "s"), (450, [float("inf"), 0.0, 0.0, 0.0], "s"), (None, [1.0] * 4, "s")]
    rows += [(0, [1.0, 2.0, 3.0, 4.0], "s")]
    found = neighbours.nearest(_vectors(shipped, rows), F.col("vec_id") % 50 == 0).collect()
    by = defaultdict(list)
    for r in sorted(found, key=lambda r: r["rank"]):
        by[r["query_id"]].append(r["vec_id"])
    assert set(by) == {0, 50, 100, 150}
    assert by[0] == [1, 2, 3, 4, 5] and by[50] == [0, 1, 2, 3, 4]


def test_few_or_no_vectors(shipped):
    few = _vectors(shipped, [(0, [1.0, 0.0], "s"), (1, [0.0, 1.0], "s"), (2, [1.0, 1.0], "s")])
    got = neighbours.nearest(few, F.col("vec_id") % 50 == 0).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 2), (2, 1)]
    assert neighbours.nearest(_vectors(shipped, []), F.col("vec_id") % 50 == 0).count() == 0


def test_chi_square():
    assert abs(neighbours.chi_square(15.507) - 0.95) < 1e-3  # 8 degrees
    assert neighbours.chi_square(0.0) == 0 and neighbours.chi_square(np.inf) == 1


# ---- fingerprints


def plain_print(text):
    w = spaced(text)
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids):
    names = {p: p for p in prints}

    def root(p):
        while names[p] != p:
            p = names[p]
        return p

    distinct = sorted(names)
    for k, a in enumerate(distinct):
        for b in distinct[k + 1 :]:
            if (a ^ b).bit_count() <= 4:
                names[root(b)] = root(a)
    least = {}
    for p, i in zip(prints, ids, strict=True):
        if i is not None:
            least[root(p)] = min(i, least.get(root(p), i))
    return [least.get(root(p)) for p in prints]


def test_simhash_query(shipped, given):
    got = {r["doc_id"]: r for r in simhash.op7_simhash(shipped, SF_DIR).collect()}
    prints = [plain_print(t) for _, t, _ in given]
    ids = [i for i, _, _ in given]
    for i, p, c in zip(ids, prints, plain_components(prints, ids), strict=True):
        assert got[i]["fingerprint"] == f"{p:016x}" and got[i]["component_id"] == c


def test_a_hub_and_a_path_are_components(spark):
    pairs = [(0, k) for k in range(1, 400)] + [(900 + k, 901 + k) for k in range(40)] + [(2000, 2000)]
    pairs += [(5000, k) for k in range(3000, 3300)]
    found = components.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    want = {k: 0 for k in range(1, 400)} | {901 + k: 900 for k in range(40)}
    want |= {k: 3000 for k in (*range(3001, 3300), 5000)}
    assert {r["node"]: r["root"] for r in found} == want and len(found) == len(want)


def test_simhash_of_odd_rows(odd, nothing):
    got = sorted((repr(r["doc_id"]), r["component_id"]) for r in simhash.near_duplicates(odd).collect())
    want = plain_components([plain_print(t) for _, t, _ in ODD], [i for i, _, _ in ODD])
    assert got == sorted((repr(i), c) for (i, _, _), c in zip(ODD, want, strict=True))
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    # nulls and blanks are one; so are the repeated rows; the two texts of id 7 differ
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == ["0", "3", "4", "5", "6", "7", "7", "8", "None"]
    assert simhash.one_of_each(nothing).count() == 0


@pytest.mark.parametrize("bits", [1, 4])
def test_links_join_what_is_near(shipped, bits):
    rng = np.random.default_rng(bits)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = [int(c) for c in centres]
    for c in centres[:10]:  # crowded groups, walked in large cells
        for _ in range(60):
            flip = sum(1 << int(b) for b in rng.choice(63, rng.integers(1, 7), replace=False))
            prints.append(int(c) ^ flip)
    prints = sorted(set(prints))
    table = shipped.createDataFrame([(p,) for p in prints], "fp long")
    links = [(r["a"], r["b"]) for r in simhash.links(table, bits).collect()]
    assert all(0 < ((a ^ b) & (1 << 64) - 1).bit_count() <= bits for a, b in links)

    def groups(edges):
        names = {p: p for p in prints}

        def root(p):
            while names[p] != p:
                p = names[p]
            return p

        for a, b in edges:
            names[root(a)] = root(b)
        out = defaultdict(set)
        for p in prints:
            out[root(p)].add(p)
        return sorted(map(sorted, out.values()))

    every = [(a, b) for k, a in enumerate(prints) for b in prints[k + 1 :] if (a ^ b).bit_count() <= bits]
    assert groups(links) == groups(every)
    assert len(links) <= len(every)


def test_counts_bound_the_bits():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 1 << 63, 500, dtype=np.uint64) for _ in range(2))
    lanes = lambda x: np.stack([np.bitwise_count((x >> np.uint64(2 * k)) & np.uint64(3)) for k in range(32)], 1).astype(int)
    manhattan = np.abs(lanes(a) - lanes(b)).sum(1)
    assert (manhattan == np.bitwise_count(simhash.unary(a) ^ simhash.unary(b))).all()
    assert (manhattan <= np.bitwise_count(a ^ b)).all()


def test_components_of_a_long_path(shipped):
    edges = shipped.range(1, 300).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    found = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert found == {k: 0 for k in range(1, 300)}


# ---- languages


def test_held_out_languages(shipped, given):
    true = {i: lang for i, _, lang in given}
    got = language.op9_language(shipped, SF_DIR).collect()
    assert len(got) == len(given)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == true[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_odd_texts_have_no_language(shipped, odd, nothing):
    model = language.fit(odd)
    found = language.identify(odd, ["doc_id", "text"], model).collect()
    for r in found:
        if not r["text"] or not any(map(str.isalpha, r["text"])):
            assert (r["__lang"], r["__score"], r["__rejected"]) == ("und", 0.0, True)
        else:
            assert r["__lang"] in ("en", "fr")
    assert language.known_language(odd).columns == odd.columns
    assert language.known_language(nothing).count() == 0


def test_foreign_text_is_rejected(shipped, given):
    rows = [*given, (10**6, "зжя щъы ююю жжж " * 40, None), (10**6 + 1, given[0][1], None)]
    kept = {r["doc_id"] for r in language.known_language(documents(shipped, rows)).collect()}
    assert 10**6 not in kept and 10**6 + 1 in kept
    assert len(kept) >= 0.97 * len(given)


# ---- mixing


def test_mixing_meets_its_targets(shipped):
    d = "/root/testdata/sf0.01"
    rows = mixing.op8_mixing(shipped, d).collect()
    labels = {r["doc_id"]: r["domain"] for r in mixing.labelled_domains(shipped.read.parquet(f"{d}/labels.parquet")).collect()}
    p = np.array([[r[f"p_{k}"] for k in mixing.DOMAINS] for r in rows])
    n, rate = (np.array([r[c] for r in rows], float) for c in ("n_tokens", "rate"))
    assert np.allclose(p.sum(1), 1) and (rate >= 0).all()
    total = (n * rate) @ p
    assert np.abs(total / total.sum() - [0.75, 0.25, 0.0]).max() < 0.02
    toxic = [r["rate"] for r in rows if labels.get(r["doc_id"]) == 2]
    assert np.mean(toxic) < 0.1

    # the same problem by many plain steps ends at the same rates
    r, ahead, big = np.ones(len(n)), np.ones(len(n)), n.sum()
    budget = (n @ p)[:2].sum() / big
    for k in range(4000):
        left = ((n * ahead) @ p / big - budget * np.array([0.75, 0.25, 0.0])) / (n @ p / big)
        new = np.maximum(0, ahead - (p @ left + mixing.PULL * (ahead - 1)) / (1 + mixing.PULL))
        ahead, r = new + (k / (k + 3) if k % 200 else 0) * (new - r), new
    assert np.abs(r - rate).mean() < 0.005


def test_mixing_of_odd_tables(shipped, odd, nothing):
    labels = shipped.createDataFrame([(3, 1, 0), (3, 0, 1), (7, None, 0), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    assert mixing.mixed(odd, labels).count() == len(ODD)
    assert mixing.mixed(odd, none).count() == len(ODD)
    assert mixing.wanted_documents(odd, labels).columns == odd.columns
    assert mixing.mixed(nothing, labels).count() == 0
    assert {r["doc_id"]: r["domain"] for r in mixing.labelled_domains(labels).collect()}[3] == 2


# ---- shards


def test_shards_are_even_and_whole(shipped):
    d = "/root/testdata/sf0.01"
    rows = sharding.op4_sharding(shipped, d).collect()
    texts = {r["doc_id"]: r["text"] for r in shipped.read.parquet(f"{d}/documents.parquet").collect()}
    held, slots = Counter(), defaultdict(list)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 16, zlib.crc32(data))
        held[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == len(texts) and set(held) == set(range(40))
    assert max(held.values()) < 1.05 * min(held.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_odd_rows(shipped, odd, nothing):
    rows = sharding.sharded(odd).collect()
    assert len(rows) == len(ODD) and {r["law"] for r in rows} == {"bytes"}
    assert sorted(r["size"] for r in rows if r["doc_id"] in (0, 1)) == [16, 16]
    assert sharding.sharded(nothing).count() == 0
    many = documents(shipped, [(1, "same", None)] * 3000)
    held = Counter(r["shard"] for r in sharding.sharded(many).collect())
    assert max(held.values()) < 200 and len(held) == 40  # a hot record is spread


def _plain_slots(rows):
    """Virtual slot of every copy of (doc_id, text) rows, from the hash of the library."""
    long = lambda v, seed: xxhash.xxh64_intdigest((v % 2**64).to_bytes(8, "little"), seed)
    out = []
    for (i, data), n in Counter((i, (t or "").encode()) for i, t, _ in rows).items():
        key = 42
        for v in (i, zlib.crc32(data), len(data) + 16):
            key = key if v is None else long(v, key)
        for copy in range(n):
            chunk = copy // sharding.RUN % sharding.CHUNKS
            slot = long(chunk, long(key, 42))
            slot -= 2**64 if slot >= 2**63 else 0
            out.append((i, len(data) + 16, zlib.crc32(data), slot % sharding.SLOTS))
    return out


@pytest.mark.parametrize("chunks", [4096, 3])
def test_slots_and_shards_are_those_of_a_plain_loop(shipped, monkeypatch, chunks):
    monkeypatch.setattr(sharding, "CHUNKS", chunks)
    rows = [*ODD, *[(77, "hot", None)] * 2500, *[(k, f"text {k}" * (k % 9), None) for k in range(100, 400)]]
    want = _plain_slots(rows)
    size, held, home = Counter(), [0] * 40, {}
    for _, n, _, slot in want:
        size[slot] += n
    for slot in sorted(size, key=lambda s: (-size[s], s)):
        home[slot] = min(range(40), key=lambda s: (held[s], s))
        held[home[slot]] += size[slot]
    docs = documents(shipped, rows)
    for parts in (1, 5):  # however the table is partitioned
        got = sharding.shard(docs.repartition(parts)).collect()
        columns = ("doc_id", "size", "text_crc32", "virtual_slot")
        assert Counter(tuple(r[c] for c in columns) for r in got) == Counter(want)
        weight, places = Counter(), defaultdict(list)
        for r in got:
            weight[r["shard"]] += r["size"]
            places[r["shard"]].append(r["slot"])
        assert sorted(weight.values()) == sorted(h for h in held if h)
        assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_a_grown_table_edits_the_map(shipped, tmp_path):
    rows = [(k, f"text {k} " * (1 + k % 13), None) for k in range(1000)]
    path = str(tmp_path / "map")
    assert sharding.newest_version(shipped, path) == 0
    shard_of = lambda n, shards=40: {
        r["doc_id"]: r["shard"] for r in sharding.shard(documents(shipped, rows[:n]), shards, path).collect()
    }
    first, same, grown = shard_of(900), shard_of(900), shard_of(1000)
    assert sharding.newest_version(shipped, path) == 3
    assert first == same and len(grown) == 1000
    assert sum(first[k] != grown[k] for k in first) < 0.15 * len(first)
    more = shard_of(1000, 41)
    assert sum(grown[k] != more[k] for k in grown) < 0.1 * len(grown) and 40 in set(more.values())
    (tmp_path / "map" / "version=000009").mkdir()  # begun by a job that was lost
    assert sharding.newest_version(shipped, path) == 4


def test_rebalancing_moves_little():
    rng = np.random.default_rng(0)
    sums = [(k, int(n), 1) for k, n in enumerate(rng.integers(1000, 2000, 4000))]
    placed = sharding.deal(sums, 40)
    more = sharding.rebalance(placed, sums, 41)
    moved = [k for k in placed if placed[k] != more[k]]
    size = Counter()
    for k, n, _ in sums:
        size[more[k]] += n
    assert max(size.values()) < 1.05 * sum(size.values()) / 41
    assert len(moved) < 1.3 * len(sums) / 41 and set(more) == set(placed)
    fewer = sharding.rebalance(placed, sums, 39)
    assert all(fewer[k] == placed[k] for k in placed if placed[k] < 39)


def test_map_versions(shipped, tmp_path):
    sums = [(0, 10, 2), (5, 7, 1), (9, 7, 3)]
    sharding.store_map(shipped, str(tmp_path), 1, {0: 1, 5: 0, 9: 0}, sums)
    sharding.store_map(shipped, str(tmp_path), 2, {0: 1, 5: 1, 9: 0}, sums)
    rows = lambda v: sorted(map(tuple, sharding.load_map(shipped, str(tmp_path), v).collect()))
    assert rows(1) == [(0, 1, 0), (5, 0, 0), (9, 0, 1)]
    assert rows(2) == [(0, 1, 0), (5, 1, 2), (9, 0, 0)]


# ---- language model


def plain_scores(rows, learns):
    counts, trie = Counter(), defaultdict(Counter)
    symbols = lambda t: [255] * 4 + list((t or "").encode()) + [254]
    for (_, text, _), learn in zip(rows, learns, strict=True):
        if learn:
            counts.update([*spaced(text), None])
            s = symbols(text)
            for p in range(4, len(s)):
                for j in range(5):
                    trie[tuple(s[p - j : p])][s[p]] += 1
    n, v = sum(counts.values()), len(counts)

    def cost(context, x):
        out, total = set(), 0.0
        for j in range(4, -1, -1):
            left = {y: c for y, c in trie.get(tuple(context[4 - j :]), {}).items() if y not in out}
            if not left:
                continue
            all_, escapes = sum(left.values()), len(left)
            if x in left:
                return total + math.log10(left[x] / (all_ + escapes))
            total += math.log10(escapes / (all_ + escapes))
            out |= set(left)
        return total - math.log10(257 - len(trie.get((), {})))

    found = []
    for i, text, _ in rows:
        tokens, s = [*spaced(text), None], symbols(text)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        score = sum(cost(s[p - 4 : p], s[p]) for p in range(4, len(s)))
        found.append((repr(i), len(tokens), sum(counts[w] > 0 for w in tokens), n, base, score))
    return sorted(found)


def _same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:4] == w[:4]
        assert g[4:] == pytest.approx(w[4:], rel=1e-9)


def _found(df):
    keys = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    return sorted((repr(r["doc_id"]), *[r[k] for k in keys]) for r in df.collect())


def test_scores_of_given_rows(shipped, given):
    learns = [zlib.crc32(str(i).encode()) % 7 != 2 for i, _, _ in given]
    df = ppm.op10_ppm(shipped, SF_DIR)
    _same(_found(df), plain_scores(given, learns))
    assert {r["doc_id"]: r["held_out"] for r in df.collect()} == {i: not k for (i, _, _), k in zip(given, learns, strict=True)}


def test_scores_in_small_blocks(shipped, odd, nothing, monkeypatch):
    for name, value in (("BLOCK_BYTES", 200), ("_PART", 64), ("_FLUSH", 50)):
        monkeypatch.setattr(ppm, name, value)
    rows = [r for r in ODD if len(r[1] or "") < 1000]
    _same(_found(ppm.scores(documents(shipped, rows), F.lit(True))), plain_scores(rows, [True] * len(rows)))
    _same(_found(ppm.scores(documents(shipped, rows), F.lit(False))), plain_scores(rows, [False] * len(rows)))
    assert ppm.scores(nothing, F.lit(True)).count() == 0
    monkeypatch.undo()
    assert ppm.scores(odd, F.lit(True)).count() == len(ODD)


# ---- pipeline


def test_pipeline_stage_by_stage(shipped, given, tmp_path):
    docs = shipped.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(shipped, docs, SF_DIR).write.parquet(str(tmp_path / str(k)))
        docs = shipped.read.parquet(str(tmp_path / str(k)))
        n = docs.count()
        assert 0.5 * before < n <= before, name
        if name != "sharding":
            assert docs.columns == columns
        if name == "near_duplicates":
            prints = [plain_print(r["text"]) for r in docs.collect()]
            assert len(set(prints)) == len(prints)
            assert all((a ^ b).bit_count() > 4 for i, a in enumerate(prints) for b in prints[i + 1 :])
        before = n
    assert corpus_pipeline.run(shipped, SF_DIR).count() == n


def test_pipeline_of_odd_rows(shipped, odd, nothing):
    for docs in (odd, nothing):
        kept = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(shipped, kept, SF_DIR)
            assert kept.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](shipped, kept, SF_DIR).count() == kept.count()
