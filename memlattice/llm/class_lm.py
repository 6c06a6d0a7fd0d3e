"""Scoring by a Brown class-based bigram model.

Every word of the training rows belongs to one class; log10 P(text) is the sum over its tokens of
log10 P(class | class before) + log10 P(word | class).

* Words of all training rows are counted in Spark; the table grows with the corpus and stays distributed.
* Exchange clustering moves each of the CORE most frequent words to the class that
  raises the bigram likelihood most, until nothing moves; its input is the CORE x CORE bigram
  table of the whole corpus, a bounded matrix.
* Every other word is put by an exchange step of its own, distributed by word: its counts beside the core's classes, over the whole corpus,
  decide; without any it goes to the class with most words.  So the model has a class for each word, however many there are.
* The KEPT most frequent words travel to the tasks with their classes (bounded in number and length).  Occurrences of other words meet
  their counts and classes in a join and are put back into their text's sequence of classes.
* P(word | class) is add-one with a slot for the unseen in every class; an unseen word leaves the class before it in force.
  Over all words, the unseen and the end of a text the probabilities add up to 1.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlattice.llm.common import Scratch, worker_state

CORE = 1024
KEPT = 1 << 17
CLASSES = 40
#: Longer words go by a digest, which bounds the size of what is sent.
NAMED_BYTES = 64
SWEEPS = 12
#: Different words that a task counts before it sends their counts.
HELD = 200_000
#: Rows scored before they are handed on, and codes tallied at a time.
SLICE, TALLIED = 256, 250_000
#: Weight of the class unigram in a transition.
PRIOR = 20.0


def tokens(text: str | None) -> list[bytes]:
    """ASCII lower case, cut at ASCII white space; a long word is a space, which no word has, and its digest."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(max(words, key=len, default=b"")) > NAMED_BYTES:
        return [w if len(w) <= NAMED_BYTES else b" " + hashlib.blake2b(w, digest_size=16).digest() for w in words]
    return words


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 7 == 2


def word_counts(train: DataFrame, text_col: str) -> DataFrame:
    """(word binary, c long) of all rows, without the end token."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for b in batches:
            for t in b["t"]:
                held.update(tokens(t))
                if len(held) > HELD:
                    yield pd.DataFrame({"word": list(held), "c": list(held.values())})
                    held.clear()
        if held:
            yield pd.DataFrame({"word": list(held), "c": list(held.values())})

    part = train.select(F.col(text_col).cast("string").alias("t")).mapInPandas(run, "word binary, c long")
    return part.groupBy("word").agg(F.sum("c").alias("c"))


class Lexicon:
    """Ids of the kept words, most frequent first; -1 for others."""

    def __init__(self, words: list[bytes]):
        self.get, self.n = {w: i for i, w in enumerate(words)}.get, len(words)

    def ids(self, text: str | None) -> np.ndarray:
        get = self.get
        words = tokens(text)
        return np.fromiter([get(w, -1) for w in words], np.int64, len(words))


class Shared:
    """A broadcast value with a name, by which a worker process knows what it has built from it."""

    def __init__(self, spark: SparkSession, value):
        self.name, self.sent = uuid.uuid4().hex, spark.sparkContext.broadcast(value)


def _once(shared: Shared, make):
    """What ``make`` builds from a shared value, once in each worker process."""
    return worker_state(("shared", shared.name), lambda: make(shared.sent.value))


def _tally(texts: Iterator, codes, size: int) -> pd.DataFrame:
    """Counts of the codes that ``codes`` makes of each text; a dense array of ``size`` bounds the memory."""
    got, held, n = np.zeros(size, np.int64), [], 0
    for t in texts:
        x = codes(t)
        held.append(x)
        n += len(x)
        if n > TALLIED:
            got += np.bincount(np.concatenate(held), minlength=size)
            held, n = [], 0
    if held:
        got += np.bincount(np.concatenate(held), minlength=size)
    at = np.nonzero(got)[0]
    return pd.DataFrame({"k": at, "c": got[at]})


def _gather(train: DataFrame, text_col: str, make, size: int) -> np.ndarray:
    """Sums over all rows the counts that tasks tally; at most ``size`` of them reach the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield _tally((t for b in batches for t in b["t"]), make(), size)

    part = train.select(F.col(text_col).alias("t")).mapInPandas(run, "k long, c long")
    rows = part.groupBy("k").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(size)
    out[rows["k"].to_numpy()] = rows["c"].to_numpy()
    return out


def core_bigrams(train: DataFrame, text_col: str, words, n: int) -> np.ndarray:
    """Counts of neighbours among the n core words, n standing for any other and for the ends of a text."""
    side = n + 1

    def make():
        lex = _once(words, Lexicon)

        def codes(t):
            x = lex.ids(t)
            x = np.concatenate(([n], np.where((x < 0) | (x >= n), n, x), [n]))
            return x[:-1] * side + x[1:]

        return codes

    return _gather(train, text_col, make, side * side).reshape(side, side)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each core word: words start dealt out by frequency rank, then each moves to the class that
    raises the likelihood of the class bigrams most.  The last row and column (everything else) stay a class of their own."""
    n = len(bigrams) - 1
    k = max(1, min(classes, n))
    cls = np.append(np.arange(n) % k, k)
    one = np.zeros((n + 1, k + 1))
    one[np.arange(n + 1), cls] = 1
    right, left = bigrams @ one, bigrams.T @ one  # a word's counts before and after each class
    table = one.T @ right
    for _ in range(sweeps):
        moved = 0
        for w in range(n):
            a, self_ = cls[w], bigrams[w, w]
            r, l = right[w].copy(), left[w].copy()
            r[a] -= self_
            l[a] -= self_
            table[a] -= r
            table[:, a] -= l
            table[a, a] -= self_
            rows, cols = table[:k], table[:, :k].T
            rs, cs = table.sum(1)[:k], table.sum(0)[:k]
            tr, tl = r.sum() + self_, l.sum() + self_
            gain = (_f(rows + r) - _f(rows)).sum(1) + (_f(cols + l) - _f(cols)).sum(1)
            d = np.arange(k)
            own = table[d, d]
            gain += _f(own + r[:k] + l[:k] + self_) - _f(own + r[:k]) - _f(own + l[:k]) + _f(own)
            gain -= _f(rs + tr) - _f(rs) + _f(cs + tl) - _f(cs)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b] += r
            table[:, b] += l
            table[b, b] += self_
            if b != a:
                moved += 1
                cls[w] = b
                right[:, a] -= bigrams[:, w]
                right[:, b] += bigrams[:, w]
                left[:, a] -= bigrams[w]
                left[:, b] += bigrams[w]
        if not moved:
            break
    return cls[:n]


def beside_classes(train: DataFrame, text_col: str, words, core_cls: np.ndarray, k: int) -> DataFrame:
    """(id, word, code, n) for every word after the core: how often it has a core word of class code before it, or, of class
    code - k, after it.  Words that travel go by their id, others (id -1) by themselves."""
    n, side = len(core_cls), 2 * k

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = _once(words, Lexicon)
        of = np.append(core_cls, -1)
        got, held, rare, many = np.zeros((lex.n + 1) * side, np.int32), [], Counter(), 0

        def settle():
            if held:
                at, c = np.unique(np.concatenate(held), return_counts=True)
                got[at] += c
                held.clear()

        def send(rare):
            keys = list(rare)
            return pd.DataFrame({"id": -1, "word": [w for w, _ in keys], "code": [c for _, c in keys], "n": list(rare.values())})

        for b in batches:
            for t in b["t"]:
                own = tokens(t)
                x = np.fromiter([lex.get(w, -1) for w in own], np.int64, len(own))
                c = of[np.where((x < 0) | (x >= n), n, x)]
                for word, near, shift in ((slice(1, None), c[:-1], 0), (slice(None, -1), c[1:], k)):
                    mine = x[word]
                    at = np.flatnonzero((near >= 0) & (mine >= n))
                    held.append(mine[at] * side + near[at] + shift)
                    many += len(at)
                    for i in np.flatnonzero((near >= 0) & (mine < 0)).tolist():
                        rare[own[i + (shift == 0)], int(near[i]) + shift] += 1
                if many > TALLIED:
                    settle()
                    many = 0
                if len(rare) > HELD:
                    yield send(rare)
                    rare.clear()
        settle()
        if rare:
            yield send(rare)
        at = np.flatnonzero(got)
        for i in range(0, len(at), HELD):
            here = at[i : i + HELD]
            yield pd.DataFrame({"id": here // side, "word": None, "code": here % side, "n": got[here]})

    part = train.select(F.col(text_col).cast("string").alias("t")).mapInPandas(run, "id long, word binary, code int, n long")
    return part.groupBy("id", "word", "code").agg(F.sum("n").alias("n"))


def placing(bigrams: np.ndarray, core_cls: np.ndarray, k: int) -> np.ndarray:
    """[code, class]: what a neighbour of that code adds to the log likelihood of a word in that class, as the class's core words have them."""
    n = len(core_cls)
    one = np.zeros((n, k))
    one[np.arange(n), core_cls] = 1
    table = one.T @ bigrams[:n, :n] @ one + 0.5
    after = np.log(table / table.sum(1, keepdims=True))  # [class, class after it]
    before = np.log(table / table.sum(0, keepdims=True))  # [class before it, class]
    return np.concatenate([before, after.T])


def place(beside: DataFrame, weights: np.ndarray) -> DataFrame:
    """(id, word, class): an exchange step of every word by itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for i in range(0, len(whole), 4096):
                b = whole.iloc[i : i + 4096]
                counts = np.zeros((len(b), len(weights)))
                for row, (codes, n) in enumerate(zip(b["codes"], b["n"], strict=True)):
                    counts[row, codes] = n
                yield pd.DataFrame({"id": b["id"], "word": b["word"], "class": np.argmax(counts @ weights, axis=1)})

    lists = beside.groupBy("id", "word").agg(F.array_sort(F.collect_list(F.struct("code", "n"))).alias("x"))
    return lists.select("id", "word", F.col("x.code").alias("codes"), F.col("x.n").alias("n")).mapInPandas(run, "id long, word binary, class int")


class Classes(NamedTuple):
    """The fitted classes: words that travel with their counts and classes, the table (word, c, class) of all others, and
    by class its number of words and tokens; totals of the training rows."""

    words: Shared
    listed: list[bytes]
    freq: np.ndarray
    cls: np.ndarray
    others: DataFrame
    k: int
    types: np.ndarray
    mass: np.ndarray
    tokens: int
    distinct: int
    ends: int


def fit_classes(train: DataFrame, scratch: Scratch, text_col: str = "text", classes: int = CLASSES) -> Classes:
    spark = train.sparkSession
    counts = scratch.save(word_counts(train, text_col))
    ends = train.count()
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("c"), "word").limit(KEPT).toArrow()
    listed, freq = top["word"].to_pylist(), top["c"].to_numpy().astype(np.float64)
    words = Shared(spark, listed)
    n_core = min(CORE, len(freq))
    bigrams = core_bigrams(train, text_col, words, n_core)
    core = exchange(bigrams, classes)
    k = int(core.max(initial=0)) + 1
    mass = np.bincount(core, weights=freq[:n_core], minlength=k)
    usual = int(np.argmax(mass))
    cls = np.append(core, np.full(len(freq) - n_core, usual))
    others = counts.limit(0).withColumn("class", F.lit(usual))
    if len(freq) > n_core:
        placed = scratch.save(place(beside_classes(train, text_col, words, core, k), placing(bigrams, core, k)))
        sent = placed.filter("id >= 0").select("id", "class").toArrow()
        cls[sent["id"].to_numpy()] = sent["class"].to_numpy()
        if distinct > len(freq):
            c, w = F.lit(int(freq[-1])), F.lit(listed[-1])
            rest = counts.filter((F.col("c") < c) | ((F.col("c") == c) & (F.col("word") > w)))
            rest = rest.join(placed.filter("id < 0").select("word", "class"), "word", "left")
            others = scratch.save(rest.select("word", "c", F.coalesce("class", F.lit(usual)).alias("class")))
    types, mass = np.bincount(cls, minlength=k).astype(float), np.bincount(cls, weights=freq, minlength=k)
    for r in others.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():  # one row a class
        types[r["class"]] += r["n"]
        mass[r["class"]] += r["c"]
    return Classes(words, listed, freq, cls, others, k, types, mass, total + ends, distinct + (ends > 0), ends)


#: Codes of a token whose class a join has to tell, and of one that has none.
ASKED, UNSEEN = 254, 255


def code_texts(docs: DataFrame, model: Classes, scratch: Scratch) -> DataFrame:
    """(i, learn, codes, log_seen, known) of the rows (i, learn, t): the class of each token, the sum of log10(count + 1) and the number of known ones."""
    words, cls, seen = model.words, model.cls, np.log10(model.freq + 1.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = _once(words, Lexicon).get
        of = np.append(cls, ASKED).astype(np.uint8)
        for b in (whole.iloc[i : i + SLICE] for whole in batches for i in range(0, len(whole), SLICE)):
            out = []
            for t in b["t"]:
                own = tokens(t)
                ids = np.fromiter([get(w, -1) for w in own], np.int64, len(own))
                out.append((of[ids].tobytes(), float(seen[ids[ids >= 0]].sum()), int((ids >= 0).sum()), [own[i] for i in np.flatnonzero(ids < 0)]))
            yield pd.concat([b[["i", "learn"]], pd.DataFrame(out, columns=["codes", "log_seen", "known", "rest"], index=b.index)], axis=1)

    kind = docs.schema["i"].dataType.simpleString()
    first = docs.mapInPandas(run, f"i {kind}, learn boolean, codes binary, log_seen double, known long, rest array<binary>")
    first = scratch.save(first.withColumn("r", F.monotonically_increasing_id()))
    # words that did not travel; none of them is frequent
    asked = first.filter(F.size("rest") > 0).select("r", F.posexplode("rest").alias("at", "word")).join(model.others, "word")
    told = asked.groupBy("r").agg(
        F.array_sort(F.collect_list(F.struct("at", "class"))).alias("x"), F.sum(F.log10(F.col("c") + 1.0)).alias("log_rest"), F.count("*").alias("more")
    )

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for codes, at, got in zip(b["codes"], b["at"], b["class"], strict=True):
                x = np.frombuffer(codes, np.uint8).copy()
                asked = np.flatnonzero(x == ASKED)
                x[asked] = UNSEEN
                if at is not None:
                    x[asked[np.asarray(at, np.int64)]] = got
                out.append(x.tobytes())
            yield b[["i", "learn", "log_seen", "known"]].assign(codes=out)

    joined = first.drop("rest").join(told, "r", "left")
    joined = joined.select(
        "i", "learn", "codes", (F.col("log_seen") + F.coalesce("log_rest", F.lit(0.0))).alias("log_seen"), (F.col("known") + F.coalesce("more", F.lit(0))).alias("known"),
        F.col("x.at").alias("at"), F.col("x.class").alias("class"),
    )
    return scratch.save(joined.mapInPandas(fill, f"i {kind}, learn boolean, log_seen double, known long, codes binary"))


def before_each(codes: np.ndarray, k: int) -> np.ndarray:
    """For each token and the end: the class of the last token before it that has one, k if there is none."""
    last = np.maximum.accumulate(np.where(codes < k, np.arange(len(codes)), -1)) if len(codes) else np.zeros(0, np.int64)
    return np.append(k, np.where(last < 0, k, codes[last].astype(np.int64)) if len(codes) else [])


def transitions(coded: DataFrame, k: int) -> np.ndarray:
    """Counts [class before or k: start, class or k: end] over the rows to learn from."""

    def make():
        def pairs(codes):
            x = np.frombuffer(codes, np.uint8).astype(np.int64)
            before, now = before_each(x, k), np.append(x, k)
            return (before * (k + 1) + now)[now <= k].astype(np.int64)

        return pairs

    return _gather(coded.filter("learn"), "codes", make, (k + 1) * (k + 1)).reshape(k + 1, k + 1)


def score_documents(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES) -> DataFrame:
    """One row for each row of ``docs``: its id, n_tokens, n_known, train_tokens, base_score and score (both log10).

    ``learn`` says which rows to learn from; all of them are counted.  A null or empty text is its end token alone.
    With no such rows every word is unseen.  Rows that repeat, or have a null id, are scored
    each by themselves.  Other columns of ``docs`` are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    rows = docs.select(F.col(id_col).alias("i"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text_col).cast("string").alias("t"))
    model = fit_classes(rows.filter("learn"), scratch, "t", classes)
    coded, k = code_texts(rows, model, scratch), model.k
    moves = transitions(coded, k)
    alone = (moves.sum(0) + 1.0) / (moves.sum() + k + 1)
    chance = (moves + PRIOR * alone) / (moves.sum(1, keepdims=True) + PRIOR)
    move, size = np.log10(chance), model.mass + model.types + 1.0
    within = np.append(np.log10(size), 0.0)  # of the class that is left, what its words share; nothing for the end
    unseen = np.log10((chance[:, :k] / size).sum(1))
    base_size, end_base, ends = float(np.log10(model.tokens + model.distinct + 1.0)), float(np.log10(model.ends + 1.0)), model.ends

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for codes, log_seen, known in zip(b["codes"], b["log_seen"], b["known"], strict=True):
                x = np.frombuffer(codes, np.uint8).astype(np.int64)
                before, now = before_each(x, k).astype(np.int64), np.append(x, k)
                got = now <= k
                s = (move[before[got], now[got]] - within[now[got]]).sum() + unseen[before[~got]].sum() + log_seen
                out.append((len(now), int(known) + (ends > 0), log_seen + end_base - base_size * len(now), float(s)))
            yield pd.concat([b[["i"]], pd.DataFrame(out, columns=["n", "known", "base", "s"], index=b.index)], axis=1)

    kind = coded.schema["i"].dataType.simpleString()
    scored = coded.mapInPandas(run, f"i {kind}, n long, known long, base double, s double")
    return scored.select(
        F.col("i").alias(id_col),
        F.col("n").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(int(model.tokens)).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        F.col("s").alias("score"),
    )
