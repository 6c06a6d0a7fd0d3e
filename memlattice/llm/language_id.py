"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds a bounded sample of labelled text.  A document is
cut greedily into the longest phrases that occur in the sample; with c phrases and u letters that the sample does not have, over
n characters and a sample of N characters, ``(c * log2(N) + u * UNSEEN) / n`` estimates the cross entropy in bits
per character (Ziv and Merhav; a phrase is a pointer into the sample, an unseen letter is spelled out).  The language with the smallest estimate wins.
Texts are folded before: lower case, and one space for whatever stands between letters, which tells of no language.
A tiny sample has cheap pointers but must spell out most of the letters of other languages, so it does not win their texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlattice.llm.common import worker_state

#: Bound of the fitted sample: different whole texts, as many as fit into CHARS_PER_LANGUAGE; with very many
#: languages, into an equal share of CHARS_IN_ALL, but not less than LEAST.  Texts of up to LONGEST characters are taken by their hashes, then, where
#: these leave room, longer ones, the shortest first.
CHARS_PER_LANGUAGE = 40_000
CHARS_IN_ALL = 400_000
LEAST = 10_000
DOCS_PER_LANGUAGE = 400
LONGEST = 600
UNDETERMINED = "und"
#: Bits of a letter that is spelled out: any code point.
UNSEEN = 21.0
BETWEEN = regex.compile(r"[^\p{L}\p{M}]+")


def suffix_automaton(text: str) -> dict:
    """The start state; a state maps a character to the next state."""
    start: dict = {}
    trans, link, length = [start], [-1], [0]
    last = 0
    for ch in text:
        cur = len(trans)
        trans.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and ch not in trans[p]:
            trans[p][ch] = cur
            p = link[p]
        if p != -1:
            q = trans[p][ch]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(trans)
                trans.append(dict(trans[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and trans[p].get(ch) == q:
                    trans[p][ch] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    for state in trans:  # numbers become the states themselves
        for ch, to in state.items():
            state[ch] = trans[to]
    return start


def fold(text: str) -> str:
    return BETWEEN.sub(" ", text.lower())


def phrases(start: dict, text: str) -> tuple[int, int]:
    """How many longest matches ``text`` is cut into, and how many of its characters are not in the sample."""
    count, unseen, state, nothing = 0, 0, {}, {}
    for ch in text:
        if ch in state:
            state = state[ch]
        elif ch in start:
            count += 1
            state = start[ch]
        else:
            unseen += 1
            state = nothing
    return count, unseen


class Model:
    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        self.parts = [(suffix_automaton(samples[k]), math.log2(len(samples[k]) + 2)) for k in self.langs]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        text = fold(text)
        rates = []
        for start, bits in self.parts:
            count, unseen = phrases(start, text)
            rates.append((count * bits + unseen * UNSEEN) / len(text))
        best = min(rates)
        return self.langs[rates.index(best)], 1.0 / sum(2.0 ** (4.0 * (best - r)) for r in rates)


def _chosen(rows: DataFrame, room: int) -> list:
    """(lang, n, h) of different texts that fill the room of their language: short ones by hash, then longer ones by length."""
    order = Window.partitionBy("lang").orderBy(F.greatest("n", F.lit(LONGEST)), "h")
    ranked = rows.select("lang", "n", "h").distinct().withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= DOCS_PER_LANGUAGE)
    ranked = ranked.withColumn("so_far", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return ranked.filter((F.col("so_far") <= room) | (F.col("rn") == 1)).collect()  # DOCS_PER_LANGUAGE a language at most


def sample(labelled: DataFrame, text_col: str, lang_col: str) -> dict[str, str]:
    """Texts to learn from, by language: different whole texts that fit into the room of a language, chosen by their length and hash alone.

    Where a language has many short texts only hashes below a bound, which leaves about four times the texts wanted, are ranked: what is sent does not grow with the
    corpus.  A language that this leaves without its fill, as copies may, is ranked whole, by lengths and hashes without the texts.
    """
    text = F.col(text_col).cast("string")
    usable = labelled.select(F.col(lang_col).alias("lang"), text.alias("t"), F.char_length(text).alias("n"), F.xxhash64(text).alias("h"))
    usable = usable.filter(F.col("lang").isNotNull() & F.col("t").rlike(r"\p{L}"))
    short = F.col("n") <= LONGEST
    counts = {r["lang"]: r["short"] for r in usable.groupBy("lang").agg(F.count(F.when(short, 1)).alias("short")).collect()}  # one row a language
    if not counts:
        return {}
    room = min(CHARS_PER_LANGUAGE, max(LEAST, CHARS_IN_ALL // len(counts)))
    bound = {k: int(4.0 * DOCS_PER_LANGUAGE / n * (1 << 64)) - (1 << 63) for k, n in counts.items() if n > 4 * DOCS_PER_LANGUAGE}
    chosen: dict[str, list] = {}
    if bound:
        limit = F.create_map(*[F.lit(x) for k, v in bound.items() for x in (k, v)])
        for r in _chosen(usable.filter(short & (F.col("h") <= limit[F.col("lang")].cast("long"))), room):
            chosen.setdefault(r["lang"], []).append(r)
    full = {k for k, v in chosen.items() if sum(r["n"] for r in v) > room - LONGEST or len(v) == DOCS_PER_LANGUAGE}
    lacking = [k for k in counts if k not in full]
    if lacking:
        for k in lacking:
            chosen.pop(k, None)
        for r in _chosen(usable.filter(F.col("lang").isin(lacking)), room):
            chosen.setdefault(r["lang"], []).append(r)
    keys = labelled.sparkSession.createDataFrame([(k, r["h"]) for k, v in chosen.items() for r in v], "lang string, h long")
    found = usable.select(F.col("lang").cast("string").alias("lang"), "h", "t").join(F.broadcast(keys), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.min("t").alias("t")).collect()
    texts = {(r["lang"], r["h"]): r["t"] for r in found}
    return {k: fold(" ".join(texts[k, r["h"]] for r in sorted(v, key=lambda r: (max(r["n"], LONGEST), r["h"])))) for k, v in chosen.items()}


def _model(samples: dict[str, str]) -> Model:
    return worker_state(("language", hash(tuple(sorted(samples.items())))), lambda: Model(samples))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def identify_language(
    docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """Adds lang_pred and score (0 to 1) to ``docs``.

    Learns from ``labelled`` (default: the rows of ``docs`` that are not held out): its text and non-null
    language only, so ids may be null or repeat.  A text that is null, empty or without letters, and any text when there is nothing to
    learn from, gets ``und`` with score 0.  Ties go to the language first by code point.  Repeated rows
    are predicted alike; columns with the names added here are replaced.
    """
    if labelled is None:
        labelled = docs.filter(~held_out(id_col))
    samples = sample(labelled, text_col, lang_col)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = _model(samples)
        for s in batches:
            yield pd.DataFrame([model.predict(t) for t in s], columns=["lang_pred", "score"])

    rows = docs.drop("lang_pred", "score")
    return rows.withColumn("__p", predict(F.col(text_col).cast("string"))).select(*[F.col(c) for c in rows.columns], "__p.lang_pred", "__p.score")
