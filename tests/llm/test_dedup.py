"""Near, exact and embedding dedup, repeats: against brute force on small tables with odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest

from memlattice.llm import embedding_dedup as embedding_module, near_dedup as near_module, repeats
from memlattice.llm.components import connected_components
from memlattice.llm.embedding_dedup import embedding_dedup
from memlattice.llm.exact_dedup import exact_dedup
from memlattice.llm.near_dedup import near_dedup, shingle_sets

DOCS = "doc_id long, text string, keep_id string, n int, root string, id string"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, "r", "i") for i, t in rows], DOCS)


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def roots(ids, linked):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(ids)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(3, 160))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, rng.choice([" ", "\t\n"]).join(x.upper() if rng.random() < 0.1 else x for x in w)))
    return rows


@pytest.mark.parametrize(("seed", "light", "tile"), [(1, 1000, 1000), (2, 1000, 2), (1, 3, 1), (2, 8, 1000)])
def test_near_dedup_equals_brute_force(spark, monkeypatch, seed, light, tile):
    """With few postings that a light token may have, most joins by token take the way of the heavy ones; small tiles cut every list."""
    monkeypatch.setattr(near_module, "LIGHT", light)
    monkeypatch.setattr(near_module, "TILE", tile)
    rows = corpus(seed) + [(900, None), (901, ""), (902, " \n"), (903, "a b c"), (904, "A\tb c"), (905, "one"), (906, "ünï " * 7000), (907, "ünï " * 7000 + "x")]
    sets = {i: shingles(t) for i, t in rows}

    def linked(a, b):
        x, y = sets[a], sets[b]
        return bool(x) and bool(y) and 100 * len(x & y) >= 85 * len(x | y)

    want = roots(sets, linked)
    got = {r.doc_id: r for r in near_dedup(frame(spark, rows)).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (want[i] == i) for i, r in got.items())


def test_pipeline_links_near_copies_from_80_percent(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = corpus(3)
    sets = {i: shingles(t) for i, t in rows}
    share = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    assert any(0.8 <= j < 0.85 for j in share.values())
    want = roots(sets, lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    got = pipeline.near_copies(spark, frame(spark, rows), "").collect()
    assert sorted(r.doc_id for r in got) == sorted(set(want.values()))
    narrow = near_dedup(frame(spark, rows)).filter("kept").count()
    assert len(got) < narrow


def test_near_dedup_odd_rows(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, "A B C D E F")]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id, r.kept) for r in near_dedup(frame(spark, rows)).collect())
    assert got == [(-1, None, False), (2, 2, True), (3, 2, False), (3, 2, False)]
    assert near_dedup(frame(spark, rows).limit(0)).count() == 0


def test_near_dedup_repeated_ids_with_different_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    got = near_dedup(frame(spark, [(1, a), (5, a), (5, b), (9, b), (7, b + " z"), (8, "b z")])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (5, 1, False), (5, 5, True), (7, 5, False), (8, 8, True), (9, 5, False)]


def test_shingle_sets_do_not_depend_on_neighbours():
    texts = ["a b c d e f g", "", None, "x y", "a b c d e f g " * 9000]
    apart = [shingle_sets([t])[0] for t in texts]
    assert all((a == b).all() for a, b in zip(shingle_sets(texts), apart, strict=True))
    assert [len(s) for s in apart] == [len(shingles(t)) for t in texts]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5)]
    want = roots({x for e in edges for x in e if e[0] != e[1]}, lambda a, b: (a, b) in pairs or (b, a) in pairs) if (pairs := set(edges)) else {}
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_dedup(spark):
    rows = [(5, "a b"), (2, "ab"), (9, "a  b "), (1, None), (4, "\n"), (7, "x"), (8, "Ab"), (None, "ab"), (3, "é\xa0"), (6, "é")]
    got = {r.doc_id: r for r in exact_dedup(frame(spark, rows)).collect()}
    assert (got[2].keep_id, got[2].group_size, got[2].kept) == (9, 4, False) and got[9].kept and not got[None].kept
    assert (got[1].keep_id, got[4].keep_id) == (4, 4) and got[7].kept and got[8].kept and got[3].kept and got[6].kept
    assert got[5].text_sha256 == hashlib.sha256(b"ab").hexdigest()
    assert got[5].n == 1 and got[5].root == "r"  # other columns pass through
    twice = exact_dedup(frame(spark, [(1, "q"), (1, "q"), (2, "z" * 300_000)])).collect()
    assert sorted((r.doc_id, r.group_size, r.kept) for r in twice) == [(1, 2, True), (1, 2, True), (2, 1, True)]
    assert exact_dedup(frame(spark, rows).limit(0)).count() == 0


def test_embedding_dedup(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(8, 6))
    x = [list(map(float, base[rng.integers(8)] * rng.uniform(0.1, 9) + rng.normal(size=6) * rng.choice([0, 0.1, 0.3]))) for _ in range(150)]
    odd = [(900, None), (901, []), (902, [0.0] * 6), (903, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (904, [float("nan")] * 6), (905, [float("inf")] * 6), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (None, x[0])]
    df = spark.createDataFrame([(i, v, 0, 1, "r") for i, v in [*enumerate(x), *odd]], "vec_id long, embedding array<double>, n_links int, node int, root string")
    got = {r.vec_id: r for r in embedding_dedup(df).collect()}
    v = np.array(x)
    v /= np.linalg.norm(v, axis=1)[:, None]
    link = (v @ v.T) >= 0.9
    np.fill_diagonal(link, False)
    want = roots(range(150), lambda a, b: link[a, b])
    assert all(got[i].n_links == link[i].sum() and got[i].component_id == want[i] and got[i].kept == (want[i] == i) for i in range(150))
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(900, 906))
    assert (got[907].component_id, got[907].n_links, got[None].component_id) == (906, 1, None)
    assert embedding_dedup(df.limit(0)).count() == 0


def test_embedding_dedup_with_many_pivots(spark, monkeypatch):
    monkeypatch.setattr(embedding_module, "ROWS_PER_PIVOT", 16)
    monkeypatch.setattr(embedding_module, "BLOCK", 16)
    rng = np.random.default_rng(7)
    base = rng.normal(size=(25, 8))
    x = np.concatenate([base[rng.integers(25, size=300)] + 0.12 * rng.normal(size=(300, 8)), np.tile(base[0], (60, 1)) + 0.02 * rng.normal(size=(60, 8)), rng.normal(size=(60, 8))])
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup(df).collect()}
    v = x / np.linalg.norm(x, axis=1)[:, None]
    link = (v @ v.T) >= 0.9
    np.fill_diagonal(link, False)
    want = roots(range(len(x)), lambda a, b: link[a, b])
    assert all(got[i].n_links == link[i].sum() and got[i].component_id == want[i] for i in range(len(x)))
    # 27 pivots: the bounds keep most vectors from most tiles, and no partner is kept away
    pivots = v[rng.permutation(len(v))[:27]]
    d = embedding_module._chords(v, pivots)
    cell = d.argmin(1)
    radius, rows = np.array([d[cell == k, k].max(initial=-np.inf) for k in range(27)]), np.bincount(cell, minlength=27)
    between = embedding_module._chords(pivots, pivots)
    near = embedding_module.near_cells(d, cell, between, radius, np.sqrt(0.2) + 1e-6)
    assert near.mean() < 0.5 and all(near[a, cell[b]] for a, b in zip(*np.nonzero(link), strict=True))
    tiles = embedding_module.Tiles(rows, between, 16)
    reached, own = tiles.reached(near), tiles.own(cell, np.arange(len(v)))
    assert max(np.bincount(own)) <= 24 and all(own[b] in reached[a] for a, b in zip(*np.nonzero(link), strict=True))


def brute_repeats(rows, n=100):
    seen, out = set(), {}
    for i, text in sorted(rows):
        b = (text or "").encode()
        cover = np.zeros(len(b) + 1, int)
        for p in range(len(b) - n + 1):
            s = b[p : p + n]
            if s in seen:
                cover[p] += 1
                cover[p + n] -= 1
            seen.add(s)
        c = np.cumsum(cover[:-1]) > 0
        out[i] = (len(b), int(c.sum()), int((np.diff(c, prepend=False) & c).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~c].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("chunk, flush", [(1 << 18, 1_500_000), (512, 40)])
def test_repeats_equal_brute_force(spark, monkeypatch, chunk, flush):
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    monkeypatch.setattr(repeats, "FLUSH", flush)
    rng = random.Random(chunk)
    passage = ["".join(rng.choice("abcdé ") for _ in range(rng.choice([60, 99, 100, 101, 140, 400]))) for _ in range(12)]
    rows = []
    for i in range(90):
        parts = [rng.choice(passage) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(0, 200))) for _ in range(rng.randrange(0, 7))]
        rows.append((i, "".join(parts)))
    rows += [(500, None), (501, ""), (502, "a" * 1500), (503, "ab" * 400), (504, "x" * 99), (505, "x" * 100), (506, "x" * 100), (507, rows[3][1]), (508, ("".join(passage) * 3)[:5000])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(frame(spark, rows)).collect()}
    assert got == brute_repeats(rows)


def test_repeats_odd_ids(spark):
    rng = random.Random(1)
    t = "".join(rng.choice("abcdef") for _ in range(150))
    got = repeats.remove_repeats(frame(spark, [(None, t), (4, t), (4, t), (2, "z" + t)])).collect()
    assert sorted(r.n_removed for r in got) == [0, 150, 150, 150] and [r.n_removed for r in got if r.doc_id == 2] == [0]
    assert repeats.remove_repeats(frame(spark, [(1, "x")]).limit(0)).count() == 0
