"""Source divergence audit: how far the word use of the sources of a language is apart, and which terms make it so.

Terms are counted by language, source and document.  A language keeps the terms of at least ``SUPPORT`` of its documents.  Most kept terms share
their row of counts by source with many others, so rows are deduplicated: terms with the same sparse vector (source, count) make up one
*column class*.  Every pair of sources is evaluated once for each class and multiplied by the number of its terms; terms themselves come
back only to be ranked.

With c occurrences in a group whose kept terms occur N times, of V kept terms, ``p = 1 + floor(10^9 (c + 1) / (N + V))``, and the divergence of p from q
is ``floor((p - q)^2 / q)``, all in whole numbers: the division goes in three steps of 1,000, so counts may be up to 9 * 10^15.

* Tasks count whole texts and send one row for each group and term they hold.
* Classes are evaluated in tasks, for blocks of ``WIDTH`` by ``WIDTH`` sources; classes with no term in either block count by their number alone. Tasks send
  sums, so memory is bounded by ``TALLIES`` blocks, and no pair of sources is ever a row of a class.
* Of the terms of a class only the first ``RANKS`` can be ranked, since they have equal values everywhere; rankings are cut by salted parts first.

The table of groups (language, source, N) is collected and travels with the tasks.  It has one row a source; the result has one for every
ordered pair of sources of a language, so the table is never more than about the square root of what is asked for, times the number of languages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlattice.llm.common import Scratch, text_or_empty

SUPPORT = 3
RANKS = 200
SCALE_STEPS = 3
#: Sources in a block, cells evaluated at a time, and blocks of sums that a task holds.
WIDTH, CELLS, TALLIES = 128, 1 << 20, 64
#: Different terms that a task counts before it sends their counts.
HELD = 200_000
SALTS = 16
TERM = re.compile(rb"[a-z\x80-\xff]+")


def shares(c: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (c + 1) / total) by long division, c + 1 <= total."""
    rest, out = np.asarray(c, np.int64) + 1, np.int64(0)
    for _ in range(SCALE_STEPS):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Groups:
    """The sources of every language: numbers of groups are consecutive within a language."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.pairs = sorted(pairs, key=lambda p: (p[0].encode(), p[1].encode()))
        self.number = {p: i for i, p in enumerate(self.pairs)}
        self.langs = sorted({lang for lang, _ in pairs}, key=str.encode)
        at = {lang: i for i, lang in enumerate(self.langs)}
        self.lang = np.array([at[lang] for lang, _ in self.pairs], np.int64)
        self.first = np.searchsorted(self.lang, np.arange(len(self.langs) + 1))
        self.held = np.zeros(len(self.pairs), np.int64)
        self.kept = np.zeros(len(self.langs), np.int64)

    def total(self) -> np.ndarray:
        """N + V of every group."""
        return self.held + self.kept[self.lang]

    def lang_total(self) -> np.ndarray:
        return np.array([self.held[a:b].sum() for a, b in zip(self.first, self.first[1:], strict=False)], np.int64) + self.kept


def _counted(docs: DataFrame, groups: Groups) -> DataFrame:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        said, documents, held = {}, {}, 0

        def send() -> Iterator[pd.DataFrame]:
            for g, words in said.items():
                terms = list(words)
                yield pd.DataFrame({"l": groups.lang[g], "g": g, "term": terms, "c": list(words.values()), "df": [documents[g][t] for t in terms]})
            said.clear()
            documents.clear()

        for b in batches:
            for lang, source, text in zip(b["lang"], b["source"], b["text"], strict=True):
                found = TERM.findall(text.encode("utf-8", "surrogatepass").lower())
                if found:
                    g = groups.number[lang, source]
                    words, docs_with = said.setdefault(g, Counter()), documents.setdefault(g, Counter())
                    before = len(words)
                    words.update(found)
                    docs_with.update(set(found))
                    held += len(words) - before
                    if held >= HELD:
                        yield from send()
                        held = 0
        yield from send()

    return docs.mapInPandas(count, "l int, g int, term binary, c long, df long")


def _flat(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, group and count of every entry of the classes in a batch."""
    lengths = np.array([len(g) for g in b["gs"]], np.int64)
    return np.repeat(np.arange(len(b)), lengths), np.concatenate(list(b["gs"])).astype(np.int64), np.concatenate(list(b["cs"])).astype(np.int64)


def pair_sums(groups: Groups, width: int = WIDTH, tallies: int = TALLIES):
    """The mapInPandas function from classes (l, gs, cs, n) to (g, item, value) summed over the classes of a task."""
    total = groups.total()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {}

        def send() -> Iterator[pd.DataFrame]:
            for (a, b), m in sums.items():
                s, t = np.nonzero(m)
                yield pd.DataFrame({"g": a + s, "item": b + t, "value": m[s, t]})
            sums.clear()

        for whole in batches:
            for lang, b in whole.groupby("l"):
                lo, hi = int(groups.first[lang]), int(groups.first[lang + 1])
                row, g, c = _flat(b)
                n = b["n"].to_numpy()
                starts = range(lo, hi, width)
                inside = {a: (g >= a) & (g < a + width) for a in starts}
                some = {a: np.bincount(row[inside[a]], minlength=len(n)) > 0 for a in starts}
                absent = {a: shares(np.zeros(min(width, hi - a), np.int64), total[a : min(a + width, hi)]) for a in starts}
                for i in starts:
                    for j in starts:
                        m = sums.setdefault((i, j), np.zeros((len(absent[i]), len(absent[j])), np.int64))
                        rows = np.flatnonzero(some[i] | some[j])
                        m += (n.sum() - n[rows].sum()) * divergence(absent[i][:, None], absent[j][None, :])
                        step = max(1, CELLS // m.size)
                        for k in range(0, len(rows), step):
                            part = rows[k : k + step]
                            p, q = (_dense(part, row, g, c, inside[a], a, absent[a], total) for a in (i, j))
                            m += (divergence(p[:, :, None], q[:, None, :]) * n[part][:, None, None]).sum(axis=0)
                        if len(sums) > tallies:
                            yield from send()
        yield from send()

    return run


def _dense(part, row, g, c, inside, start, absent, total) -> np.ndarray:
    """Shares of the classes ``part`` in a block of sources, those of count 0 with them."""
    out = np.tile(absent, (len(part), 1))
    at = inside & np.isin(row, part)
    out[np.searchsorted(part, row[at]), g[at] - start] = shares(c[at], total[g[at]])
    return out


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", support: int = SUPPORT, ranks: int = RANKS, width: int = WIDTH) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks the other sources of the language by divergence from them, part ``term``
    the ``ranks`` kept terms that the source uses more than its language does, by divergence from the language.

    Null text, language and source count as empty, an empty one is a language or source like others.  Groups without terms are there, with counts of 0; a
    language without kept terms has pairs of value 0.  A repeated row is a document of its own.  Ties go to the smaller item in UTF-8.
    Other columns do not matter; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "audit")
    read = docs.select(text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source"), text_or_empty(text_col).alias("text"))
    groups = Groups([(r["lang"], r["source"]) for r in read.select("lang", "source").distinct().collect()])  # one row a source: see above
    numbered = spark.createDataFrame([(i, *p) for i, p in enumerate(groups.pairs)], "g int, lang string, source string")

    by_term = _counted(read, groups).repartition("l", "term").groupBy("l", "term", "g").agg(F.sum("c").alias("c"), F.sum("df").alias("df"))
    vector = F.array_sort(F.collect_list(F.struct("g", "c"))).alias("v")
    kept = by_term.groupBy("l", "term").agg(F.sum("df").alias("df"), vector).filter(F.col("df") >= support)
    terms = scratch.save(kept.select("l", "term", F.col("v.g").alias("gs"), F.col("v.c").alias("cs")))
    classes = scratch.save(terms.groupBy("l", "gs", "cs").agg(F.count("*").alias("n")))

    entries = classes.select("n", F.explode(F.arrays_zip("gs", "cs")).alias("e")).groupBy(F.col("e.gs").alias("g")).agg(F.sum(F.col("e.cs") * F.col("n")).alias("held"))
    for r in entries.collect():  # one row a source
        groups.held[r["g"]] = r["held"]
    for r in classes.groupBy("l").agg(F.sum("n").alias("n")).collect():
        groups.kept[r["l"]] = r["n"]

    pairs = _pairs(classes, numbered, groups, width)
    ranked = _terms(scratch, terms, classes, groups, ranks)
    other = numbered.select(F.col("g").alias("item_g"), F.col("source").alias("item"))
    order = Window.partitionBy("g").orderBy(F.desc("value"), "item")
    pairs = pairs.join(other, pairs["t"] == other["item_g"]).select("g", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    out = pairs.union(ranked.select("g", F.lit("term").alias("part"), "item", "value", "rank"))
    return out.join(numbered, "g").select("lang", "source", "part", "item", "value", "rank")


def _pairs(classes: DataFrame, numbered: DataFrame, groups: Groups, width: int) -> DataFrame:
    """(g, t, value) of every ordered pair of sources of a language."""

    def nothing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for g in b["g"]:
                lang = groups.lang[g]
                t = np.arange(groups.first[lang], groups.first[lang + 1])
                yield pd.DataFrame({"g": g, "item": t[t != g], "value": 0})

    schema = "g int, item int, value long"
    sums = classes.mapInPandas(pair_sums(groups, width), schema).filter("g != item")
    every = numbered.select("g").mapInPandas(nothing, schema).union(sums)
    return every.groupBy("g", F.col("item").alias("t")).agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))


def _terms(scratch: Scratch, terms: DataFrame, classes: DataFrame, groups: Groups, ranks: int) -> DataFrame:
    """(g, item, value, rank) of the first terms of every group."""
    total, lang_total = groups.total(), groups.lang_total()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                row, g, c = _flat(b)
                lang = b["l"].to_numpy()
                over = np.zeros(len(b), np.int64)
                np.add.at(over, row, c)
                p, q = shares(c, total[g]), shares(over, lang_total[lang])[row]
                at = p > q
                got = b.iloc[row[at]]
                yield pd.DataFrame({"l": got["l"], "gs": got["gs"], "cs": got["cs"], "g": g[at], "value": divergence(p, q)[at]})

    key = ["l", "gs", "cs"]
    scored = classes.mapInPandas(score, "l int, gs array<int>, cs array<long>, g int, value long")
    best = _cut(scored, ["g"], [F.desc("value")], F.rank, ranks, F.xxhash64(*key))
    best = scratch.save(best.select(*key, "g", "value"))
    firsts = _cut(terms.join(best.select(*key).distinct(), key, "left_semi"), key, ["term"], F.row_number, ranks, F.xxhash64("term"))
    found = firsts.select(*key, "term").join(best, key).select("g", F.col("term").cast("string").alias("item"), "value")
    return _cut(found, ["g"], [F.desc("value"), "item"], F.row_number, ranks, F.xxhash64("item"))


def _cut(rows: DataFrame, by: list[str], order: list, number, most: int, salt) -> DataFrame:
    """The rows of rank up to ``most``, cut within salted parts first."""
    salted = rows.withColumn("salt", F.pmod(salt, F.lit(SALTS)))
    for keys in ([*by, "salt"], by):
        salted = salted.withColumn("rank", number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= most)
    return salted.drop("salt")
