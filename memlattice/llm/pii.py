"""Personal data by patterns, and information-theoretic sanitisation of what gives it away.

Patterns find protected entities: e-mail addresses, IPv4 addresses, card and telephone numbers.  A term
(a run of letters) near an entity may reveal it as well.  With document frequencies over the whole corpus,
``PMI(e; t) = log2(p(e, t) / (p(e) p(t)))`` is what the term discloses of the entity and
``IC(e) = -log2 p(e)`` all there is; a term that discloses more than ALPHA of it, in SUPPORT different
contexts or more, is removed wherever it occurs in a document that holds the entity (C-sanitisation,
Sanchez and Batet).  Contexts, not copies of one context, count as support; they are taken around every entity.
p(e, t) is the share of documents that hold both, near each other or not.

All of it is DataFrame functions.  Matches are rows, never lists that travel with other rows, and one sort of a document's terms and entities
tells which terms are inside spans: work is n log n in a document's matches.  An entity looks only at the terms within REACH long ones and WIDE of any length, which it
meets by blocks of WIDE terms, and documents that hold a pair apart are only counted where that can decide, from the side of the term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlattice.llm.common import Scratch, text_or_empty

#: Share of an entity's information from which on a term is removed.
ALPHA = 0.9
#: Different contexts that must show an entity and a term together.
SUPPORT = 2
#: Terms of LONG letters or more on either side of an entity that, with the shorter ones between them, count as its context, and how many terms of any length
#: that may be on either side.
REACH, LONG, WIDE = 8, 3, 32
KINDS = ("email", "ip", "card", "phone", "term")
TERM = r"\p{L}++"

_L = r"A-Za-z0-9._%+-"
#: The base patterns.  A match can only begin where a run of its first characters begins (or
#: where the match before ended), and possessive repeats give the same matches here without
#: backtracking, so that very long runs take linear time and no stack.
PATTERNS = {
    "email": rf"(?:(?<![{_L}])|\G)[{_L}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold to have a span of the kind: plain characters, or a pattern that starts with a digit and so is quick to rule out.
_TRIGGER = {"email": ("@", None), "ip": (".", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), "card": (None, r"[0-9](?:[\x20-]?[0-9]){11}"), "phone": ("+", None)}


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _accepted(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(match, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))
    if kind == "card":
        d = _digits(match)
        return F.length(d).between(12, 19) & F.coalesce(F.call_function("luhn_check", d), F.lit(False))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _likely(kind: str, text: Column) -> Column:
    mark, pattern = _TRIGGER[kind]
    c = F.contains(text, F.lit(mark)) if mark else F.lit(True)
    return c & text.rlike(pattern) if pattern else c


def _matches(pattern: str, text: Column) -> Column:
    """(m, g) of the matches in order: the match and the number of characters between it and the one before."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    return F.zip_with(found, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("m"), F.char_length(g).alias("g")))


def _placed(found: DataFrame, *keys: str) -> DataFrame:
    """Adds start and end to matches (i, m, g): running sums of lengths, a row a match and no lists."""
    along = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("g") + F.char_length("m")).over(along).cast("int")
    return found.withColumn("end", end).withColumn("start", F.col("end") - F.char_length("m")).drop("g", "i")


def base_spans(rows: DataFrame, text: str = "text") -> DataFrame:
    """(row, kind, start, end, value) of all spans of the four kinds.  Texts that cannot hold a kind are not searched for it."""
    t, each = F.col(text), None
    for number, kind in enumerate(KINDS[:4]):
        found = rows.filter(_likely(kind, t)).select("row", F.lit(number).alias("kind"), F.posexplode(_matches(PATTERNS[kind], t)).alias("i", "x"))
        found = found.select("row", "kind", "i", "x.m", "x.g")
        each = found if each is None else each.union(found)
    placed = _placed(each, "row", "kind")
    accepted = F.lit(False)
    for number, kind in enumerate(KINDS[:4]):
        accepted = accepted | ((F.col("kind") == number) & _accepted(kind, F.col("m")))
    return placed.filter(accepted).select("row", "kind", "start", "end", F.col("m").alias("value"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, support: int = SUPPORT, reach: int = REACH) -> DataFrame:
    """One row for each row of ``docs``: its id, base (array of start, kind, end, value) and terms (array of start, kind, end).

    Offsets are code points, ends exclusive.  A null text counts as empty and has no spans.  Rows that repeat an id
    are separate documents.  Other columns of ``docs`` are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    t = text_or_empty(text_col)
    some = F.lit(False)
    for k in KINDS[:4]:
        some = some | _likely(k, F.col("text"))
    rows = docs.select(F.col(id_col).alias("id"), t.alias("text"))
    # the text is kept only where there may be something to protect
    rows = scratch.save(rows.select("id", F.when(some, F.col("text")).alias("text")).withColumn("row", F.monotonically_increasing_id()))
    spans = scratch.save(base_spans(rows.filter("text is not null")))
    entity = spans.select("row", "start", "end", F.sha2(F.concat_ws(":", "kind", F.lower("value")), 256).alias("entity"))
    holds = scratch.save(entity.select("entity", "row").distinct())
    found = rows.join(holds.select("row").distinct(), "row", "left_semi")
    found = found.select("row", F.posexplode(_matches(TERM, F.col("text"))).alias("i", "x")).select("row", "i", "x.m", "x.g")
    term = _placed(found, "row").select("row", "start", "end", F.lower("m").alias("term"), F.lit(None).cast("string").alias("entity"))
    mixed = term.union(entity.select("row", "start", "end", F.lit(None).cast("string"), "entity"))
    # a sweep over terms and entities in page order: letters inside a span are part of it
    order = Window.partitionBy("row").orderBy("start", "end", "entity")
    back = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = F.max(F.when(F.col("entity").isNotNull(), F.col("end"))).over(back)
    later = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("end"), F.desc("entity")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = F.min(F.when(F.col("entity").isNotNull(), F.col("start"))).over(later)
    mixed = mixed.withColumn("begins", begins).withColumn("ends", ends)
    mixed = mixed.filter(F.col("entity").isNotNull() | ((F.coalesce("ends", "start") <= F.col("start")) & (F.coalesce("begins", "end") >= F.col("end")))).drop("begins", "ends")
    mixed = mixed.withColumn("n", F.count(F.when(F.char_length("term") >= LONG, 1)).over(back)).withColumn("m", F.count("term").over(back))
    mixed = scratch.save(mixed)
    term = mixed.filter("term is not null").select("row", "start", "end", "term", "n", "m")
    # an entity at place m asks for the blocks that its neighbours may be in: at most three times WIDE terms, however short they are
    asks = mixed.filter("entity is not null").select("row", "entity", F.col("n").alias("at"), F.col("m").alias("place")).distinct()
    asks = asks.select("*", F.explode(F.array(*[F.floor(F.col("place") / WIDE) + d for d in (-1, 0, 1)])).alias("block"))
    blocks = term.select("row", F.floor(F.col("m") / WIDE).alias("block"), "n", "m", "start", "term")
    near = asks.join(blocks, ["row", "block"]).withColumn("offset", F.col("n") - F.col("at"))
    near = near.filter(F.col("offset").between(-reach + 1, reach) & (F.col("m") - F.col("place")).between(1 - WIDE, WIDE))
    # a context is what stands around the occurrences of an entity between two long terms
    around = near.groupBy("row", "entity", "at").agg(F.array_sort(F.collect_set(F.struct("offset", "start", "term"))).alias("x"))
    context = F.xxhash64(F.transform("x", lambda y: F.struct(y["offset"], y["term"])))
    around = scratch.save(around.select("row", "entity", context.alias("context"), F.array_distinct("x.term").alias("terms")))
    seen = around.select("row", "entity", "context", F.explode("terms").alias("term"))
    both = seen.groupBy("entity", "term", "context").agg(F.count("*").alias("n")).groupBy("entity", "term").agg(F.count("*").alias("contexts"))
    both = both.filter(F.col("contexts") >= support).select("entity", "term")
    near_docs = seen.select("entity", "term", "row").distinct().groupBy("entity", "term").agg(F.count("*").alias("df_near"))
    both = scratch.save(both.join(near_docs, ["entity", "term"]))
    listed = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "value"))).alias("base"))
    rows = rows.select("id", "row").join(listed, "row", "left")
    if not both.isEmpty():
        df_entity = holds.groupBy("entity").agg(F.count("*").alias("df_entity"))
        words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(f"({TERM})"), F.lit(1)))).alias("term"))
        df_term = words.groupBy("term").agg(F.count("*").alias("df_term"))
        total = F.lit(float(docs.count()))
        stats = both.join(df_entity, "entity").join(df_term, "term").filter(F.col("df_entity") < total)

        def discloses(df_both: Column) -> Column:
            pmi = F.log2(df_both * total / (F.col("df_entity") * F.col("df_term")))
            return pmi >= F.lit(alpha) * F.log2(total / F.col("df_entity"))

        # PMI grows with the documents that hold both: at least those that show them near, at most all of either
        stats = scratch.save(stats.filter(discloses(F.least("df_entity", "df_term"))).withColumn("sure", discloses(F.col("df_near"))))
        apart = term.select("row", "term").distinct().join(stats.filter("not sure"), "term").join(holds, ["row", "entity"], "left_semi")
        apart = apart.groupBy("entity", "term", "df_entity", "df_term").agg(F.count("*").alias("df_both")).filter(discloses(F.col("df_both")))
        flagged = stats.filter("sure").select("entity", "term").union(apart.select("entity", "term"))
        marked = holds.join(flagged, "entity").select("row", "term").distinct()
        gone = term.join(marked, ["row", "term"]).groupBy("row").agg(F.collect_list(F.struct("start", F.lit(KINDS.index("term")).alias("kind"), "end")).alias("terms"))
        rows = rows.join(gone, "row", "left")
    else:
        rows = rows.withColumn("terms", F.lit(None).cast("array<struct<start:int,kind:int,end:int>>"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    nothing = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    return rows.select(F.col("id").alias(id_col), F.coalesce("base", nothing).alias("base"), F.coalesce("terms", none).alias("terms"))


def span_list(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` joined with ``sanitised``: base spans generalised to their kind in brackets, disclosing terms to [TERM].

    Needs ids that do not repeat.  Of overlapping spans the first covers the text, the others only what it leaves.
    """
    found = find_pii(docs, id_col, text_col, **options)
    bare = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    spans = found.select(F.col(id_col).alias("__id"), F.array_sort(F.concat(bare, "terms")).alias("__spans"))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    rows = docs.drop("sanitised")
    joined = rows.join(spans, F.col(id_col).eqNullSafe(F.col("__id")), "left")
    t = text_or_empty(text_col)

    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] > acc["at"], F.substring(t, acc["at"] + 1, s["start"] - acc["at"])).otherwise(F.lit(""))
        new = F.when(s["end"] > acc["at"], F.concat(acc["out"], gap, F.element_at(names, s["kind"] + 1))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), new.alias("out"))

    whole = F.aggregate("__spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.char_length(t))))
    return joined.select(*[F.col(c) for c in rows.columns], F.coalesce(whole, t).alias("sanitised"))
