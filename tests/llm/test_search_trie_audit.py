"""Nearest neighbours, prefix tries and the divergence audit: against brute force on small tables with odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlattice.llm import divergence, prefix_trie
from memlattice.llm.divergence import Groups, audit, pair_sums
from memlattice.llm.prefix_trie import Louds, conversation_trie
from memlattice.llm.vector_search import Forest, nearest, on_sphere

VECTORS = "vec_id long, embedding array<double>, score double, rank int, x string, leaves string"


def vectors(spark, rows):
    """Vectors with extra columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, v, 0.0, 1, "x", "l") for i, v in rows], VECTORS)


def brute_nearest(rows, k=20):
    out = {}
    for q, v in rows:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(w, v, strict=True)), i) for i, w in rows if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def recall(got, want):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("kind", ["noise", "clusters", "norms"])
def test_nearest_recall(spark, kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16))
    if kind == "clusters":
        x = rng.normal(size=(30, 16))[rng.integers(0, 30, 3000)] + 0.1 * x
    if kind == "norms":
        x *= np.exp(rng.normal(size=(3000, 1)))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want = brute_nearest(rows)
    got = lists(nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, leaf_rows=64, block=500))
    assert recall(got, want) >= 0.93
    for q, found in got.items():
        assert len(found) == 20 and found == sorted(found, key=lambda f: (-f[1], f[0]))
        assert all(s == pytest.approx(float(np.dot(x[i], x[q])), rel=1e-12) for i, s in found)


def test_nearest_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(70)]
    copies = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(100, 400)]  # more equal vectors than anyone's list is long
    short = [(500, [1.0, 1.0]), (501, [0.5, 0.5])]
    odd = [(600, None), (620, [0.0] * 4), (640, [float("nan"), 1.0, 1.0, 1.0]), (660, [None, 1.0, 1.0, 1.0]), (680, []), (700, [float("inf")] * 4)]
    good = rows + copies + short
    table = vectors(spark, good + odd + [(None, [1.0] * 4)])
    got, want = lists(nearest(table, F.col("vec_id") % 20 == 0, block=64)), brute_nearest(good)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]], q
    assert [i for i, _ in got[100]] == list(range(101, 121))
    assert got[500] == [(501, 1.0)]
    again = vectors(spark, good + [(100, [9.0] * 4), rows[0]])  # ids that repeat: one row each
    assert max(len(f) for f in lists(nearest(again, F.col("vec_id") % 20 == 0)).values()) == 20
    huge = vectors(spark, [(0, [1e200, 0.0]), (1, [1e200, 0.0]), (2, [1e-200, 1e-200])])
    assert [i for i, _ in lists(nearest(huge, F.col("vec_id") % 20 == 0))[0]] == [1, 2]
    assert nearest(table.filter("false"), F.lit(True)).count() == 0
    assert nearest(table.filter("vec_id in (600, 620)"), F.lit(True)).count() == 0


def test_forest_puts_every_row_in_a_leaf_of_each_tree():
    rng = np.random.default_rng(1)
    x = on_sphere(rng.normal(size=(400, 5)), 2.0)
    forest = Forest(x, 3, 16)
    homes = forest.homes(x)
    assert [set(forest.tree_of[homes[:, t]]) for t in range(3)] == [{0}, {1}, {2}]
    m = forest.margins(x)
    for i in range(0, 400, 37):
        assert set(forest.search(m[i], 0.0)) == set(homes[i])
        assert sorted(forest.search(m[i], np.inf)) == list(range(forest.n_leaves))
    same = Forest(np.ones((50, 3)), 2, 16)
    assert same.n_leaves == 2  # nothing to cut


TURNS = "conv_id long, turn long, role string, text string, node string, depth int, h int, pos string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "n", 1, 1, "p") for r in rows], TURNS)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


def brute_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h]) + tuple(ts[h:])
    nodes = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(ts[:d], []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes)]
        saved = sum((len(nodes[p]) - 1) * (words(p[-1][1]) if p else 0) for p in below)
        ended = ",".join(map(str, sorted(c for c in members if built[c] == path)))
        up = min(nodes[path[:-1]]) if path else None
        out.append((min(members), len(path), up, len(members), len(children), len(leaves), saved, hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=str)


def some_turns(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.choice([0, 1, 1, 2, 4, 7])):
            hot = rng.random() < 0.6
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", "hi there" if hot and t < 3 else f"w{rng.randrange(3)} x"))
    rows += [(c, t, "user", "the same") for c in range(1000, 1030) for t in range(12)]  # copies, a long common path
    return rows


@pytest.mark.parametrize("shard_turns", [1, 20, 200, 50_000])
def test_trie_is_what_brute_force_finds(spark, shard_turns):
    rows = some_turns(shard_turns)
    got = conversation_trie(turns(spark, rows), shard_turns=shard_turns)
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(rows)


def test_trie_odd_rows(spark):
    rows = [
        (None, 0, "user", "no conversation"), (3, None, "user", "first"), (3, 1, None, "b"), (3, 1, None, "a"), (3, 1, None, "a"), (3, 0, "user", None),
        (7, 0, "a", "bc"), (8, 0, "ab", "c"), (-7, 0, "user", "below zero"), (-7, 1, "user", "x"), (-20, 5, "user", "base"), (41, 0, "user", "gone"), (2**62, 0, "user", "y"),
        (60, 0, "user", "word " * 20000), (61, 0, "user", "word " * 20000), *[(80, t, "user", "long") for t in range(300)],
    ]
    for shard_turns in (5, 50_000):
        got = conversation_trie(turns(spark, rows), shard_turns=shard_turns)
        assert sorted(map(tuple, got.collect()), key=str) == brute_trie(rows)
    assert conversation_trie(turns(spark, rows).filter("false")).count() == 0
    assert conversation_trie(turns(spark, [(None, 1, "user", "x")])).count() == 0
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_louds_bits_and_sums():
    # a forest: r -> (a -> c, b), and a top s of another depth
    node, parent = [b"r", b"a", b"b", b"c", b"s"], [b"", b"r", b"r", b"a", b"?"]
    trie = Louds(node, parent, np.array([1, 2, 2, 3, 9]), np.array([0, 1, 2, 3, 4]))
    assert [node[i] for i in trie.order] == [b"r", b"s", b"a", b"b", b"c"]
    assert "".join("01"[int(b)] for b in trie.bits) == "110" + "110" + "0" + "10" + "0" + "0"
    assert trie.parents().tolist() == [0, 0, 1, 1, 3]
    assert trie.roll_up(np.array([1, 10, 100, 1000, 10000])).tolist() == [11101, 10, 10100, 1000, 10000]


def test_ends_are_listed_by_number_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "END_BUCKET", 4)
    convs = [-9, -1, 0, 3, 4, 10, 9, 100]
    got = prefix_trie.ends(spark.createDataFrame([(bytearray(b"n"), c) for c in convs], "node binary, conv long")).collect()
    assert [r["ends_sha256"] for r in got] == [hashlib.sha256(",".join(map(str, sorted(convs))).encode()).hexdigest()]


DOCS = "doc_id long, text string, lang string, source string, l string, g int, gs string, value long, rank int, term string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, "l", 1, "g", 1, 1, "t") for i, (lang, s, t) in enumerate(rows)], DOCS)


def brute_audit(rows, support=3, ranks=200):
    rows = [(lang or "", s or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for lang, s, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        held = {}
        for _, _, ts in mine:
            for t in set(ts):
                held[t] = held.get(t, 0) + 1
        kept = [t for t, n in held.items() if n >= support]

        def share(some, kept=kept):
            c = {t: 0 for t in kept}
            for _, _, ts in some:
                for t in ts:
                    if t in c:
                        c[t] += 1
            total = sum(c.values()) + len(kept)
            return c, {t: 1 + 10**9 * (n + 1) // total for t, n in c.items()}

        _, whole = share(mine)
        each = {s: share([r for r in mine if r[1] == s]) for s in {r[1] for r in mine}}
        f = lambda p, q: (p - q) ** 2 // q
        for s, (c, p) in each.items():
            pairs = [(-sum(f(p[t], q[t]) for t in kept), o.encode()) for o, (_, q) in each.items() if o != s]
            terms = [(-f(p[t], whole[t]), t.encode()) for t in kept if c[t] > 0 and p[t] > whole[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:ranks])):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


def some_docs(seed):
    rng = random.Random(seed)
    rows = []
    for k in range(150):
        s = f"s{min(rng.randrange(9), rng.randrange(9))}"
        some = [f"{s if rng.random() < 0.3 else 'w'}{chr(97 + rng.randrange(26))}" for _ in range(rng.randrange(0, 60))]
        rows.append((rng.choice(["en", "en", "de"]), s, rng.choice([" ", ", ", "9"]).join(w.upper() if rng.random() < 0.2 else w for w in some)))
    return rows


@pytest.mark.parametrize("width,ranks", [(128, 200), (2, 5)])
def test_audit_is_what_brute_force_finds(spark, width, ranks):
    rows = some_docs(width)
    got = audit(docs(spark, rows), width=width, ranks=ranks)
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, ranks=ranks)


def test_audit_odd_rows(spark):
    odd = [
        (None, None, "Ähre ähre ÄHRE x_y 红烧 [a] {b}\x7fc\x00d"), (None, "", "ähre X y 红烧"), ("", None, "x y"), ("", "s", None), ("zz", "a", "one"), ("zz", "b", None), ("zz", None, ""),
        ("en", "big", "word " * 30000 + "other " * 7), ("en", "big", "word other"), ("en", "t1", "word tie1 tie2"), ("en", "t1", "tie2 tie1"), ("en", "t2", "tie1 tie2 other"), ("en", "t2", "tie1 tie2 other"),
    ]
    got = audit(docs(spark, odd))
    assert sorted(map(tuple, got.collect())) == brute_audit(odd)
    assert audit(docs(spark, odd).filter("false")).count() == 0
    assert {r["value"] for r in got.filter("lang = 'zz'").collect()} == {0}


def test_shares_are_exact_beyond_doubles():
    c, total = np.array([0, 1, 10**14 + 7, 9 * 10**15 - 2]), np.array([10**15, 3, 10**14 + 9, 9 * 10**15])
    assert divergence.shares(c, total).tolist() == [1 + 10**9 * (int(a) + 1) // int(b) for a, b in zip(c, total, strict=True)]


def test_sums_are_sent_before_they_are_too_many():
    import pandas as pd

    groups = Groups([("en", f"s{i}") for i in range(6)])
    groups.held[:], groups.kept[:] = 5, 2
    batch = pd.DataFrame({"l": [0, 0], "gs": [[0], [1, 5]], "cs": [[5], [5, 3]], "n": [1, 3]})
    once, often = (pd.concat(pair_sums(groups, w, t)(iter([batch, batch]))).groupby(["g", "item"])["value"].sum() for w, t in ((128, 64), (2, 1)))
    assert once.to_dict() == {k: v for k, v in often.to_dict().items() if v}
