"""Full-text search, vector search, fusion and the recall pipelines built of them.

A search reads and tokenises the text once: of a document's term list only the query's own terms and the length are kept, and these narrow
rows are written down, since the corpus statistics and the scores both need them.  Nothing is shuffled but the one row of statistics, and top-k is
``TakeOrderedAndProject``.  Where many queries are wanted, ``top_of_many`` scores them in tiles, ``postings`` and ``score_postings`` by a join on the term;
``chunk_index`` keeps the postings of notes on disk.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlattice.functions import scoring, text
from memlattice.operators.chunk_index import FIELDS, ChunkIndex
from memlattice.operators.ranking import first_wins, quota, top_of_each
from memlattice.schemas import PUBLIC
from memlattice.session import cut_lineage

_CJK = re.compile("[一-鿿]+|[a-z0-9_]+")


def query_terms(query: str) -> tuple[list[str], list[str]]:
    """(required, optional) terms of one query, on the driver: the same rules as the column functions of ``functions.text``."""
    q = (query or "").strip().lower()
    q = "".join(chr(ord(c) - 0xFEE0) if 0xFF01 <= ord(c) <= 0xFF5E else " " if c == "　" else '"' if c in "“”‘’'" else c for c in q).strip().strip('"').strip()
    required, optional = [], []
    for p in _CJK.findall(q):
        if "一" <= p[0] <= "鿿":
            pairs = [p[i : i + 2] for i in range(len(p) - 1)]
            optional += [*p, *pairs]
            required += pairs if len(p) > 2 else [p]
        else:
            optional.append(p)
            required.append(p)
    return list(dict.fromkeys(required)), list(dict.fromkeys(optional))


def scope_filter(scope: str, column: str = "memory_scope") -> Column:
    """Rows that a scope may see: its own and the public ones."""
    if not (scope or "").strip():
        raise ValueError("a scope is needed")
    return F.col(column).isin(*sorted({scope.strip(), PUBLIC}))


def terms_of(queries: list[str]) -> list[str]:
    """All terms of some queries, in order."""
    asked = [query_terms(q) for q in queries]
    return list(dict.fromkeys(t for required, optional in asked for t in optional + required))


def text_hits(docs: DataFrame, id_col: str, fields: list[str], terms: list[str], keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """(id, kept columns, for each field the terms h that it holds and its length l) of every document, and the one row of corpus statistics.

    The text is read and tokenised once: only these narrow rows are used from here on.
    """
    wanted, n = F.array(*[F.lit(t) for t in terms]).cast("array<string>"), range(len(fields))
    rows = docs.select(F.col(id_col).alias("id"), *keep, *[text.index_tokens(F.col(f)).alias(f"t{i}") for i, f in enumerate(fields)])
    rows = cut_lineage(rows.select("id", *keep, *[F.array_intersect(f"t{i}", wanted).alias(f"h{i}") for i in n], *[F.size(f"t{i}").alias(f"l{i}") for i in n]))
    number = [(i, t) for i in n for t in terms]
    counts = [F.count_if(F.array_contains(f"h{i}", t)).alias(f"n{k}") for k, (i, t) in enumerate(number)]
    return rows, rows.agg(F.count("*").alias("n"), *[F.avg(f"l{i}").alias(f"avg{i}") for i in n], *counts)


def _score_columns(rows: DataFrame, stats: DataFrame, queries: list[str], n_fields: int) -> tuple[DataFrame, list[tuple[Column, Column]]]:
    """The rows that hold a term beside the statistics, and for each query its score and whether all its required terms are there."""
    asked, terms, n = [query_terms(q) for q in queries], terms_of(queries), range(n_fields)
    number = {(i, t): k for k, (i, t) in enumerate((i, t) for i in n for t in terms)}
    joined = rows.filter(F.size(F.concat(*[F.col(f"h{i}") for i in n])) > 0).crossJoin(F.broadcast(stats))  # one row
    have = F.array_distinct(F.concat(*[F.col(f"h{i}") for i in n]))
    out = []
    for required, optional in asked:
        term = lambda i, t: scoring.bm25_term(F.col("n"), F.col(f"n{number[i, t]}"), F.col(f"l{i}"), F.col(f"avg{i}"))
        score = sum((F.when(F.array_contains(f"h{i}", t), term(i, t)).otherwise(0.0) for i in n for t in optional), F.lit(0.0))
        out.append((score, F.size(F.array_except(F.array(*[F.lit(t) for t in required]).cast("array<string>"), have)) == 0))
    return joined, out


def score_documents(docs: DataFrame, id_col: str, fields: list[str], query: str, keep: list[str] = ()) -> DataFrame:
    """(id, kept columns, bm25_score, strict) of the documents that hold a term of the query."""
    joined, [(score, strict)] = _score_columns(*text_hits(docs, id_col, fields, terms_of([query]), list(keep)), [query], len(fields))
    return joined.select("id", *keep, score.alias("bm25_score"), strict.alias("strict")).filter("bm25_score > 0")


def score_many(rows: DataFrame, stats: DataFrame, queries: list[str], keep: list[str], n_fields: int) -> DataFrame:
    """(id, kept columns, query, bm25_score, strict) of a few queries, from the hits of a text or of a stored index."""
    joined, each = _score_columns(rows, stats, queries, n_fields)
    found = F.array(*[F.struct(F.lit(q).alias("query"), score.alias("bm25_score"), strict.alias("strict")) for q, (score, strict) in zip(queries, each, strict=True)])
    return joined.select("id", *keep, F.explode(found).alias("x")).select("id", *keep, "x.*").filter("bm25_score > 0")


def postings(docs: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """The inverted index: (field, term, id, length)."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), text.index_tokens(F.col(f)).alias("tokens")) for f in fields]))
    rows = docs.select(F.col(id_col).alias("id"), each.alias("x")).select("id", "x.field", "x.tokens", F.size("x.tokens").alias("length"))
    return rows.select("field", F.explode("tokens").alias("term"), "id", "length")


def index_statistics(docs: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n, average): documents and their average length."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.size(text.index_tokens(F.col(f))).alias("length")) for f in fields]))
    return docs.select(each.alias("x")).groupBy("x.field").agg(F.count("*").alias("n"), F.avg("x.length").alias("average"))


def score_postings(index: DataFrame, statistics: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, id, bm25_score) for a table of queries (query, term): the postings meet the terms in a join."""
    asked = queries.select("query", "term").distinct()
    hit = index.join(asked.select("term").distinct(), "term", "left_semi")
    freq = hit.groupBy("field", "term").agg(F.count("*").alias("df"))
    hit = hit.join(freq, ["field", "term"]).join(F.broadcast(statistics), "field")
    each = hit.withColumn("s", scoring.bm25_term(F.col("n"), F.col("df"), F.col("length"), F.col("average")))
    return each.join(asked, "term").groupBy("query", "id").agg(F.sum("s").alias("bm25_score"))


#: Documents and queries that are scored together, as one matrix.
TILE_DOCS, TILE_QUERIES = 4096, 256


def top_of_many(docs: DataFrame, id_col: str, text_col: str, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(query, id, score) of the ``k`` best documents of each query (query, term), by the score rounded to ``digits``, then by id.

    A document's terms stay one row: documents are dealt in tiles by their id, tiles meet blocks of queries, and what a tile cannot place among the first k never
    leaves it.  The score is a product: what the length makes of it, times the sum of the weights of the terms that are in both.
    """
    rows = cut_lineage(docs.select(F.col(id_col).alias("id"), text.index_tokens(F.col(text_col)).alias("terms")))
    asked = cut_lineage(queries.select("query", "term").filter("term is not null").distinct())
    stats = rows.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("average")).first()
    n, average, tiles = stats["n"], stats["average"] or 1.0, 1 + stats["n"] // TILE_DOCS
    freq = rows.select("terms").mapInArrow(_batch_counts, "term string, df long").join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    each = asked.join(freq, "term").withColumn("weight", scoring.idf(F.lit(n), F.col("df")))
    blocks = asked.select(F.count_distinct("query") / F.lit(TILE_QUERIES)).first()[0]
    each = each.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(1 + int(blocks))).cast("int"))
    each = each.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    of_id = F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int")
    rows = rows.withColumn("tile", of_id).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(int(blocks)))))
    fields = {f.name: f.dataType.simpleString() for f in [*rows.schema.fields, *each.schema.fields]}
    out = f"query {fields['query']}, id {fields['id']}, score double"

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        return _tile_top(left, right, average, k, digits)

    found = rows.groupBy("tile", "block").cogroup(each.groupBy("tile", "block")).applyInArrow(score, out)
    found = found.withColumn("score", F.round("score", digits))
    return top_of_each(found, ["query"], [F.desc("score"), F.col("id")], k)


def _batch_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df) of each batch of term lists."""
    import pyarrow.compute as pc

    for b in batches:
        counts = pc.value_counts(pc.list_flatten(b.column(0)))
        yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], ["term", "df"])


def _tile_top(docs: pa.Table, weights: pa.Table, average: float, k: int, digits: int) -> pa.Table:
    """(query, id, score) of the documents of a tile that can be among the first k of a query."""
    import numpy as np
    import pyarrow.compute as pc

    docs = docs.take(pc.sort_indices(docs, sort_keys=[("id", "ascending")], null_placement="at_start")).combine_chunks()
    weights = weights.combine_chunks()
    names, ids = pc.dictionary_encode(weights["query"].combine_chunks(), null_encoding="encode"), docs["id"].combine_chunks()
    terms = pc.unique(weights["term"])
    table = np.zeros((len(terms) + 1, len(names.dictionary)))
    table[pc.index_in(weights["term"].combine_chunks(), terms).to_numpy(), names.indices.to_numpy()] = weights["weight"].to_numpy()
    lists = docs["terms"].combine_chunks()
    length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    owner = pc.list_parent_indices(lists).to_numpy()
    place = pc.fill_null(pc.index_in(pc.list_flatten(lists), terms), len(terms)).to_numpy()
    known = place < len(terms)
    owner, place = owner[known], place[known]
    norm = (scoring.K1 + 1.0) / (1.0 + scoring.K1 * (1.0 - scoring.B + scoring.B * length / average))
    total = np.zeros((len(docs), table.shape[1]))
    step = max(1, 4_000_000 // max(1, table.shape[1]))  # terms whose weights are in memory at a time
    starts = np.searchsorted(owner, np.arange(len(docs) + 1))
    at = 0
    while at < len(docs):
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + step, side="right")) - 1)
        here = np.flatnonzero(starts[at + 1 : end + 1] > starts[at:end]) + at  # documents that hold a term
        if len(here):
            total[here] = np.add.reduceat(table[place[starts[at] : starts[end]]], starts[here] - starts[at], axis=0)
        at = end
    total *= norm[:, None]
    # rows that repeat an id are one document
    text_ids = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
    first = np.flatnonzero(np.concatenate([[True], text_ids[1:] != text_ids[:-1]])) if len(docs) else np.zeros(0, dtype=np.int64)
    if len(first) < len(docs):
        total = np.add.reduceat(total, first, axis=0)
    # by rounded score, then place; where rounding is close to the half either side counts, so that no row is lost
    scaled = total * 10.0**digits
    low, high = np.floor(scaled + 0.5 - 1e-3).astype(np.int64), np.floor(scaled + 0.5 + 1e-3).astype(np.int64)
    back = len(first) - np.arange(len(first))[:, None]
    low, high = low * (len(first) + 1) + back, high * (len(first) + 1) + back
    low[total <= 0] = -1
    keep = total > 0
    if len(first) > k:
        keep &= high >= np.partition(low, len(first) - k, axis=0)[len(first) - k]
    d, q = np.nonzero(keep)
    return pa.table([names.dictionary.take(pa.array(q)), ids.take(pa.array(first[d])), pa.array(total[d, q])], names=["query", "id", "score"])


def update_postings(index: DataFrame, changed: DataFrame, deleted: DataFrame | None, id_col: str, fields: list[str]) -> DataFrame:
    """The index after some documents changed or went: only theirs are made anew."""
    gone = changed.select(F.col(id_col).alias("id"))
    gone = gone if deleted is None else gone.union(deleted.select(F.col(id_col).alias("id")))
    return index.join(gone.distinct(), "id", "left_anti").select("field", "term", "id", "length").union(postings(changed, id_col, fields))


def staged_search(docs: DataFrame, id_col: str, fields: list[str], query: str, limit: int) -> DataFrame:
    """Strict hits first, then, if they are fewer than ``limit``, the others; at most three times ``limit`` rows.

    Columns: id, stage (0 strict), bm25_score, bm25_normalized_score (share of the highest), rank.
    """
    scored = score_documents(docs, id_col, fields, query)
    most = 3 * limit
    # one pass over the text: the ranks of a stage are cut in every task before its rows meet
    rn = F.row_number().over(Window.partitionBy("stage").orderBy(F.desc("bm25_score"), "id"))
    both = scored.withColumn("stage", F.when(F.col("strict"), 0).otherwise(1)).withColumn("rn", rn).filter(F.col("rn") <= most).drop("rn")
    # at most six times limit rows from here on
    every = Window.partitionBy()
    both = both.withColumn("n_strict", F.count_if(F.col("stage") == 0).over(every)).filter((F.col("stage") == 0) | (F.col("n_strict") < limit))
    both = both.withColumn("rank", F.row_number().over(Window.orderBy("stage", F.desc("bm25_score"), "id"))).filter(F.col("rank") <= most)
    high = F.max("bm25_score").over(every)
    share = F.when(high > 0, F.col("bm25_score") / high).otherwise(0.0)
    return both.select("id", "stage", "bm25_score", share.alias("bm25_normalized_score"), "rank")


def bm25_only(docs: DataFrame, id_col: str, fields: list[str], query: str, limit: int) -> DataFrame:
    """The staged hits in stage order, scored by their share of the highest score."""
    hits = staged_search(docs, id_col, fields, query, limit).orderBy("rank").limit(limit)
    return hits.select("id", "bm25_score", "bm25_normalized_score", F.col("bm25_normalized_score").alias("final_score"), F.lit("bm25").alias("score_kind"), "rank")


def vector_top_k(rows: DataFrame, id_col: str, vec_col: str, query: list[float], k: int, threshold: float = -1.0) -> DataFrame:
    """(id, score) of the k rows of highest cosine, those below the threshold then taken away; other dimensions are skipped."""
    q = F.array(*[F.lit(float(x)) for x in query])
    fits = rows.filter(F.col(vec_col).isNotNull() & (F.size(vec_col) == len(query)))
    scored = fits.select(F.col(id_col).alias("id"), scoring.cosine(F.col(vec_col), q).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(k).filter(F.col("score") >= threshold)


def fuse(hits: DataFrame, vectors: DataFrame, limit: int, min_share: float = 0.5, min_final_score: float | None = None) -> DataFrame:
    """Reciprocal-rank fusion of text hits (id, bm25_score) and vector hits (id, score).

    Text hits are ranked by score alone.  Without text hits there is no result.  What scores below ``min_share`` of the best
    (or below ``min_final_score``) goes.
    """
    every = Window.partitionBy()
    b = hits.select("id", "bm25_score", "bm25_normalized_score").withColumn("rb", F.row_number().over(Window.orderBy(F.desc("bm25_score"), "id"))).withColumn("nb", F.count("*").over(every))
    v = vectors.select("id", F.col("score").alias("vector_score")).withColumn("rv", F.row_number().over(Window.orderBy(F.desc("vector_score"), "id"))).withColumn("nv", F.count("*").over(every))
    j = b.join(v, "id", "full")
    nb, nv = F.max("nb").over(every), F.coalesce(F.max("nv").over(every), F.lit(0))
    j = j.withColumn("all_nb", nb).filter(F.col("all_nb").isNotNull())
    j = j.withColumn("final_score", scoring.rrf(F.coalesce("rb", nb + 1), F.coalesce("rv", nv + 100)))
    top = F.max("final_score").over(every)
    keep = F.col("final_score") >= (F.lit(min_final_score) if min_final_score is not None else F.lit(min_share) * F.col("top"))
    j = j.withColumn("top", top).filter(keep).orderBy(F.desc("final_score"), "id").limit(limit)
    return j.select(
        "id", F.coalesce("bm25_score", F.lit(0.0)).alias("bm25_score"), F.coalesce("bm25_normalized_score", F.lit(0.0)).alias("bm25_normalized_score"),
        F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"), "final_score", F.lit("rrf").alias("score_kind"),
    )


def rank_normalize(rows: DataFrame, order: list[Column]) -> Column:
    """1 for the first, 0 for the last, evenly between; 1 for a single row."""
    n = F.count("*").over(Window.partitionBy())
    rn = F.row_number().over(Window.orderBy(*order))
    return F.when(n == 1, 1.0).otherwise(1.0 - (rn - 1) / (n - 1))


Scorer = Callable[[str, list[str]], list[float]]


def rerank(candidates: DataFrame, query: str, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """Candidates (id, text) by an external scorer, in batches; scores as shares of the highest, by rank if none is positive."""

    @F.pandas_udf("double")
    def score(texts: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([float(x) for x in scorer(query, list(texts.fillna(ids)))])

    every = Window.partitionBy()
    rows = candidates.withColumn("rerank_score", score(F.col(text_col), F.col("id").cast("string")))
    high = F.max("rerank_score").over(every)
    rows = rows.withColumn("share", rank_normalize(rows, [F.desc("rerank_score"), F.col("id")]))
    return rows.withColumn("final_score", F.when(high > 0, F.col("rerank_score") / high).otherwise(F.col("share"))).drop("share").withColumn("score_kind", F.lit("rerank"))


def rerank_once(candidates: DataFrame, query: str, scorer: Scorer) -> DataFrame | None:
    """(id, final_score, score_kind) of a short list of candidates, or nothing if the scorer fails.  The scores are fetched here, so the scorer
    is asked once and cannot fail later."""
    ranked = rerank(candidates, query, scorer).select("id", "final_score", "score_kind")
    try:
        rows = ranked.collect()
    except Exception as e:  # the scorer is the caller's
        if "PythonException" not in type(e).__name__ and not isinstance(e, ValueError):
            raise
        return None
    return candidates.sparkSession.createDataFrame(rows, ranked.schema)


def normalize_rerank_response(payload) -> list[tuple[int, float]]:
    """(index, score) pairs of a reranker's answer: a list, or an object that has it under results, data, data.results or items."""
    if isinstance(payload, dict):
        code = payload.get("code")
        if code not in (None, 0, 200, "0", "200"):
            return []
        inner = payload.get("data")
        found = payload.get("results") or (inner.get("results") if isinstance(inner, dict) else inner) or payload.get("items") or []
    else:
        found = payload or []
    out = []
    for place, item in enumerate(found):
        if isinstance(item, dict):
            score = item.get("relevance_score", item.get("score"))
            if score is not None:
                out.append((int(item.get("index", place)), float(score)))
    return out


def search_with_strategy(
    docs: DataFrame, id_col: str, fields: list[str], query: str, limit: int, vectors: DataFrame | None = None, scorer: Scorer | None = None, text_col: str | None = None
) -> DataFrame:
    """Text search alone, fused with vectors, or reranked, by what there is; a reranker that fails gives way to the rung below."""
    hits = staged_search(docs, id_col, fields, query, limit)
    plain = bm25_only(docs, id_col, fields, query, limit) if vectors is None else fuse(hits, vectors, limit)
    cols = ["id", "final_score", "score_kind"]
    if scorer is None:
        return plain.select(*cols)
    ids = hits.select("id", F.lit(1).alias("src"), "rank")
    if vectors is not None:
        ids = vectors.select("id", F.lit(0).alias("src"), F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank")).union(ids)
    ids = first_wins(ids, ["id"], [F.col("src"), F.col("rank")])
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col or fields[-1]).alias("text"))
    ranked = rerank_once(ids.join(texts, "id", "left"), query, scorer)
    return plain.select(*cols) if ranked is None else ranked.orderBy(F.desc("final_score"), "id").select(*cols)


def recall(memories: DataFrame, query: str, limit: int, scope: str, vectors: DataFrame | None = None, scorer: Scorer | None = None, scope_mode: str = "pre") -> DataFrame:
    """Memories for a query: strategy ladder over many candidates, score threshold by kind, scope, limit.

    ``scope_mode="post"`` filters the scope only after ranking, as an over-fetching engine would.
    """
    pool = memories.filter(scope_filter(scope)) if scope_mode == "pre" else memories
    rows = pool.withColumn("tags_text", F.array_join("tags", " "))
    found = search_with_strategy(rows, "id", ["tags_text", "judgment"], query, max(20, 20 * limit), vectors, scorer)
    good = found.filter((F.col("score_kind") == "rrf") | (F.col("final_score") >= 0.5))
    joined = pool.join(F.broadcast(good), "id")  # at most a few times limit rows; vectors may name memories that the scope does not see
    joined = joined if scope_mode == "pre" else joined.filter(scope_filter(scope))
    return joined.orderBy(F.desc("final_score"), "id").limit(limit)


def comprehensive_recall(memories: DataFrame, query: str, limit: int, scope: str, now: float, vectors: DataFrame | None = None, scorer: Scorer | None = None) -> DataFrame:
    """Recall of three times the limit, passive memories weakened by age, the best ``limit``; vectors alone if nothing else is found."""
    strong = None if vectors is None else vectors.filter("score >= 0.5").orderBy(F.desc("score"), "id").limit(3 * limit)
    found = recall(memories, query, 3 * limit, scope, strong, scorer).withColumn("similarity", F.col("final_score"))
    if strong is not None:
        alone = memories.filter(scope_filter(scope)).join(F.broadcast(strong), "id").withColumn("similarity", F.col("score")).withColumn("final_score", F.col("score")).withColumn("score_kind", F.lit("vector")).drop("score")
        empty = found.agg(F.count("*").alias("found"))
        found = found.unionByName(alone.crossJoin(F.broadcast(empty)).filter("found = 0").drop("found"))
    age = (F.lit(now) - F.col("created_at")) / 86400.0
    found = found.withColumn("similarity", scoring.time_decay(F.col("similarity"), age, F.col("is_active")))
    return found.orderBy(F.desc("similarity"), F.desc("final_score"), "id").limit(limit)


def chained_recall(memories: DataFrame, query: str, entities: list[str], per_type: int, final: int, scope: str, now: float, vectors: DataFrame | None = None) -> DataFrame:
    """The recall pool cut by quotas: up to three memories an entity, in the entities' order, then up to ``per_type`` a type."""
    pool_size = max(100, 10 * final, 20 * per_type)
    pool = comprehensive_recall(memories, query, pool_size, scope, now, vectors)
    pool = pool.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("similarity"), "id")))  # pool_size rows
    named = entity_quota(pool, entities, 3)
    rest = pool.join(F.broadcast(named.select("id")), "id", "left_anti")
    typed = quota(rest, ["memory_type"], [F.col("pos")], per_type)
    first_of_type = F.min("pos").over(Window.partitionBy("memory_type"))
    typed = typed.withColumn("grp", first_of_type).select("id", F.lit(1).alias("part"), F.col("grp").alias("o1"), F.col("pos").alias("o2"))
    order = named.select("id", F.lit(0).alias("part"), F.col("entity_no").alias("o1"), F.col("pos").alias("o2")).union(typed)
    out = pool.join(F.broadcast(order), "id").orderBy("part", "o1", "o2").limit(final)
    return out.drop("part", "o1", "o2")


def entity_quota(pool: DataFrame, entities: list[str], most: int) -> DataFrame:
    """(id, pos, entity_no): memories that name an entity, ``most`` each, an entity's share taken before the next one's.

    A memory counts for one entity.  One round for each of the (few) entities, so that what an earlier one took is not offered again.
    """
    names = F.concat_ws(" ", F.col("judgment"), F.array_join("tags", " "))
    taken = None
    for no, entity in enumerate(dict.fromkeys(e for e in entities if e)):
        free = pool if taken is None else pool.join(taken.select("id"), "id", "left_anti")
        mine = free.filter(F.contains(F.lower(names), F.lit(entity.lower()))).orderBy("pos").limit(most)
        mine = mine.select("id", "pos", F.lit(no).alias("entity_no"))
        taken = mine if taken is None else taken.union(mine)
    return pool.select("id", "pos", F.lit(0).alias("entity_no")).filter(F.lit(False)) if taken is None else taken


def recall_by_type(memories: DataFrame, query: str, limit: int, scope: str, memory_type: str, vectors: DataFrame | None = None, pre_filter: bool = False) -> DataFrame:
    """Recall, of which one type is kept; by default after the limit, so fewer rows than that may come."""
    base = memories.filter(F.col("memory_type") == memory_type) if pre_filter else memories
    return recall(base, query, limit, scope, vectors).filter(F.col("memory_type") == memory_type)


def simple_recall(memories: DataFrame, query: str, entities: list[str], limit: int, scope: str) -> DataFrame:
    """The runtime without embeddings: entities join the query, no age, no quotas."""
    return recall(memories, " ".join([query, *entities]).strip(), limit, scope)


def ordered_lookup(memories: DataFrame, ids: list[str], scope: str) -> DataFrame:
    """Memories by id in the order asked for, each once, as far as the scope sees them."""
    asked = memories.sparkSession.createDataFrame([(i, n) for n, i in enumerate(dict.fromkeys(ids))], "id string, pos int")
    return memories.filter(scope_filter(scope)).join(F.broadcast(asked), "id").orderBy("pos").drop("pos")


#: Files that a note search looks for at least, and the most chunks of a stage that it goes through.
LEAST_FILES, MOST_HITS = 50, 20_000


def fetch_ceiling(term: str, n: int) -> int:
    """Chunks of a stage that are gone through for n results: more for a short CJK term, which many chunks hold."""
    compact = re.sub(r"\s+", "", term)
    base, cjk = max(50, 8 * n), re.search("[一-鿿]", compact)
    hits = max(base, 800) if cjk and len(compact) <= 1 else max(base, 240) if cjk and len(compact) <= 3 else base
    return min(MOST_HITS, 8 * hits)


def term_hits(rows: DataFrame, stats: DataFrame, terms: list[str], n: int, per_file: int) -> DataFrame:
    """(query, id, file_id, score) for each term by itself, in one pass over the hits: strict ones, then others, ``per_file`` of a file over both, up to the chunk
    that makes it enough files, ``n`` chunks at most."""
    scored = score_many(rows, stats, terms, ["file_id"], len(FIELDS))
    scored = scored.select("query", "id", "file_id", F.when(F.col("strict"), 0).otherwise(1).alias("stage"), F.col("bm25_score").alias("score"))
    ceilings = {t: fetch_ceiling(t, n) for t in terms}
    best = F.row_number().over(Window.partitionBy("query", "stage").orderBy(F.desc("score"), "id"))
    own = F.create_map(*[F.lit(x) for kv in ceilings.items() for x in kv])[F.col("query")]
    cut = scored.withColumn("rn", best).filter(F.col("rn") <= max(ceilings.values())).filter(F.col("rn") <= own).drop("rn")
    # from here on at most 2 * MOST_HITS rows a term
    order = [F.col("stage"), F.desc("score"), F.col("id")]
    ranked = cut.withColumn("rn", F.row_number().over(Window.partitionBy("query", "file_id").orderBy(*order))).filter(F.col("rn") <= per_file)
    of_query = Window.partitionBy("query").orderBy(*order)
    files = F.sum((F.col("rn") == 1).cast("int")).over(of_query.rowsBetween(Window.unboundedPreceding, -1))
    ranked = ranked.withColumn("files", F.coalesce(files, F.lit(0))).withColumn("place", F.row_number().over(of_query))
    return ranked.filter((F.col("files") < max(n, LEAST_FILES)) & (F.col("place") <= n)).select("query", "id", "file_id", "score")


def note_search(chunks: DataFrame, query: str, limit: int, per_file: int = 2, base: int = 50, scorer: Scorer | None = None, index: ChunkIndex | None = None) -> DataFrame:
    """Chunks for a query of one or more terms: each term is searched, chunks with more terms first, then higher scores, ``per_file`` a file.

    With a stored index no chunk is tokenised; its postings must be those of ``chunks``.  A scorer reranks what was found; if it fails the order stays.
    """
    rows = chunks.withColumn("id", F.concat_ws("#", "file_id", "chunk_index"))
    parts = list(dict.fromkeys(p for p in re.split(r"\s*\|\s*|\s+", query.strip()) if p and query_terms(p)[1]))
    if not parts:
        return rows.withColumn("matched", F.lit(0)).withColumn("score", F.lit(0.0)).filter(F.lit(False))
    found = text_hits(rows, "id", list(FIELDS), terms_of(parts), ["file_id"]) if index is None else index.hits(terms_of(parts))
    hits = term_hits(*found, parts, limit if len(parts) == 1 else max(3 * limit, base), per_file)
    best = hits.groupBy("id").agg(F.count_distinct("query").alias("matched"), F.max("score").alias("score"))
    found = rows.join(F.broadcast(best), "id")
    order = [F.desc("matched"), F.desc("score"), F.col("id")]
    found = top_of_each(found, ["file_id"], order, per_file)
    if scorer is not None:
        ranked = rerank_once(found.select("id", F.col("content").alias("text")), query, scorer)
        if ranked is not None:
            scored = found.drop("score").join(F.broadcast(ranked.select("id", F.col("final_score").alias("score"))), "id")
            return scored.orderBy(F.desc("score"), "id").limit(limit)
    return found.orderBy(*order).limit(limit)


def notes_until_files(ranked: DataFrame, files: int, per_file: int) -> DataFrame:
    """Of ranked chunks (file_id, rank) up to ``per_file`` a file, ending with the chunk that makes it ``files`` files.

    Only the first ranks of the files are put in order, of which ``files`` are kept.
    """
    capped = quota(ranked, ["file_id"], [F.col("rank")], per_file)
    firsts = ranked.groupBy("file_id").agg(F.min("rank").alias("rank")).orderBy("rank").limit(files)
    last = firsts.agg(F.max("rank").alias("last"), F.count("*").alias("files"))
    return capped.crossJoin(F.broadcast(last)).filter((F.col("files") < files) | (F.col("rank") <= F.col("last"))).drop("last", "files")


def active_recall(memories: DataFrame, query: str, scope: str, now: float, limit: int = 50, **options) -> DataFrame:
    """What the recall tool shows: active memories of a comprehensive recall, grouped by type in order of first appearance."""
    found = comprehensive_recall(memories, query, limit, scope, now, **options).filter("is_active")
    found = found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), F.desc("final_score"), "id")))  # limit rows
    return found.withColumn("place", F.min("rank").over(Window.partitionBy("memory_type"))).orderBy("place", "rank")


def vector_documents(vectors: DataFrame, docs: DataFrame, id_col: str, vec_col: str, query_vector: list[float], k: int, threshold: float = -1.0, offset: int = 0) -> DataFrame:
    """The nearest vectors with their documents (id), distance (1 - score) and a number as vector_id, counted from ``offset``."""
    top = vector_top_k(vectors, id_col, vec_col, query_vector, k, threshold)
    top = top.withColumn("distance", 1.0 - F.col("score")).withColumn("vector_id", F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1 + offset)  # k rows
    return docs.join(F.broadcast(top), "id")


def hashing_embedder(dim: int = 64) -> Callable[[Column], Column]:
    """A deterministic embedder for tests: hashed character pairs, normalised."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import zlib

        import numpy as np

        for s in batches:
            out = []
            for t in s:
                v = np.zeros(dim)
                for a, b in zip(t or "", (t or "")[1:]):
                    v[zlib.crc32((a + b).encode()) % dim] += 1.0
                n = np.linalg.norm(v)
                out.append((v / (n or 1.0)).astype("float32"))
            yield pd.Series(out)

    return embed


def embed_distinct(rows: DataFrame, text_col: str, embed: Callable[[Column], Column], out: str = "embedding") -> DataFrame:
    """Embeds every distinct text once and hands the vector to all rows that have it."""
    once = rows.select(text_col).distinct().withColumn(out, embed(F.col(text_col)))
    return rows.drop(out).join(once, text_col, "left")


def vector_diff(truth: DataFrame, index: DataFrame) -> DataFrame:
    """(item_id, change) with missing, orphan or changed, from truth and index (item_id, vector_text)."""
    t = truth.filter(F.col("vector_text") != "").select("item_id", F.col("vector_text").alias("t"))
    i = index.select("item_id", F.col("vector_text").alias("i"))
    change = F.when(F.col("i").isNull(), "missing").when(F.col("t").isNull(), "orphan").when(F.col("t") != F.col("i"), "changed")
    return t.join(i, "item_id", "full").select("item_id", change.alias("change")).filter("change is not null")


def vector_upsert(index: DataFrame, rows: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """The index with the rows (item_id, vector_text, pos) embedded and put in place; the first row of an id wins."""
    new = embed_distinct(first_wins(rows, ["item_id"], [F.col("pos")]), "vector_text", embed)
    return index.join(new.select("item_id"), "item_id", "left_anti").select("item_id", "vector_text", "embedding").unionByName(new.select("item_id", "vector_text", "embedding"))


def follow_records(index: DataFrame, records: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """The index (item_id, vector_text, embedding) after the memories changed, as by feedback: rows of memories that are gone go, new and
    changed texts are embedded, all others stay as they are."""
    rows = records.select(F.col("id").alias("item_id"), F.col("vector_text")).filter("vector_text != ''")
    return vector_sync(rows, index.join(rows.select("item_id"), "item_id", "left_semi"), embed)


def vector_sync(truth: DataFrame, index: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """The index after missing and changed rows are embedded and orphans gone."""
    diff = vector_diff(truth, index)
    keep = index.join(diff.filter("change = 'orphan'"), "item_id", "left_anti")
    need = truth.join(diff.filter("change in ('missing', 'changed')").select("item_id"), "item_id").withColumn("pos", F.lit(0))
    return vector_upsert(keep, need, embed)
