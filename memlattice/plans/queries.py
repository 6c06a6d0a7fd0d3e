"""Registered queries, each beside the DuckDB SQL of its result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlattice.functions import jsonscan, scoring, tags as T, text
from memlattice.operators import browse, chat as C, lifecycle as L, notes as N, ranking as R, retrieval as V, simulate as S, store
from memlattice.operators.chunk_index import ChunkIndex
from memlattice.operators.vector_cells import VectorCells
from memlattice.plans import views as W
from memlattice.plans.views import NOW, sql
from memlattice.session import cut_lineage, share_path, shared_folder
from memlattice.sources import files, snapshots
from memlattice.streaming import stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
QUERY = "the and src1"
REC = ["id", "judgment", "strength", "useful_count", "useful_score", "last_recalled_at", "last_decay_at"]


def register(oracle: str | None = None):
    def put(f):
        QUERIES[f.__name__] = lambda spark, d: f(share_path(spark), d)
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def r6(name: str):
    return F.round(name, 6).alias(name)


# ---------------------------------------------------------------- text search


def bm25_sql(source: str, id_col: str, fields: list[str], query: str) -> str:
    """CTEs up to scored(id, bm25_score, strict) for Latin text."""
    required, terms = V.query_terms(query)
    tok = ", ".join(f"list_distinct(regexp_extract_all(lower({f}), '[a-z0-9_]+')) as t{i}" for i, f in enumerate(fields))
    stats = ", ".join([f"avg(len(t{i})) as a{i}" for i in range(len(fields))] + [f"count(*) filter (list_contains(t{i}, '{t}')) as n{i}_{k}" for i in range(len(fields)) for k, t in enumerate(terms)])
    score = " + ".join(
        f"case when list_contains(t{i}, '{t}') then ln(1 + (n - n{i}_{k} + 0.5) / (n{i}_{k} + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(t{i}) / a{i})) else 0 end"
        for i in range(len(fields)) for k, t in enumerate(terms)
    )
    have = " or ".join
    strict = " and ".join("(" + have(f"list_contains(t{i}, '{t}')" for i in range(len(fields))) + ")" for t in required)
    return f"tok as (select {id_col} as id, {tok} from {source}), st as (select count(*) as n, {stats} from tok), scored as (select * from (select id, {score} as bm25_score, {strict} as strict from tok, st) where bm25_score > 0)"


def staged_sql(limit: int, scored: str = "scored", out: str = "staged") -> str:
    m = 3 * limit
    return (
        f"{out}_s as (select *, 0 as stage from {scored} where strict order by bm25_score desc, id limit {m}), {out}_l as (select *, 1 as stage from {scored} where not strict order by bm25_score desc, id limit {m}), "
        f"{out}_u as (select * from {out}_s union all select * from {out}_l where (select count(*) from {out}_s) < {limit}), "
        f"{out} as (select id, stage, bm25_score, bm25_score / max(bm25_score) over () as bm25_normalized_score, rank from (select *, row_number() over (order by stage, bm25_score desc, id) as rank from {out}_u) where rank <= {m})"
    )


_FIELDS = ["tags_text", "judgment"]
_MT = "mt as (select *, array_to_string(tags, ' ') as tags_text from mem)"


def _mt(spark, d):
    return W.memories(spark, d).withColumn("tags_text", F.array_join("tags", " "))


@register(f"{sql('mem')}, {_MT}, {bm25_sql('mt', 'id', _FIELDS, QUERY)}, {staged_sql(20)} select id, stage, round(bm25_score, 6) as bm25_score, round(bm25_normalized_score, 6) as bm25_normalized_score, rank from staged")
def bm25_staged(spark, d):
    return V.staged_search(_mt(spark, d), "id", _FIELDS, QUERY, 20).select("id", "stage", r6("bm25_score"), r6("bm25_normalized_score"), "rank")


@register(f"{sql('mem')}, {_MT}, {bm25_sql('mt', 'id', _FIELDS, QUERY)}, {staged_sql(20)} select id, round(bm25_normalized_score, 6) as final_score, rank from staged order by rank limit 20")
def bm25_only(spark, d):
    return V.bm25_only(_mt(spark, d), "id", _FIELDS, QUERY, 20).select("id", r6("final_score"), "rank")


@register(f"{sql('mem')}, {_MT}, {bm25_sql('mt', 'id', _FIELDS, QUERY)} select s.id, round(bm25_score, 6) as bm25_score from scored s join mem using (id) where memory_scope in ('a', 'public') order by s.bm25_score desc, id limit 25")
def bm25_recall(spark, d):
    hits = V.score_documents(_mt(spark, d), "id", _FIELDS, QUERY, ["memory_scope"]).filter(V.scope_filter("a"))
    return hits.orderBy(F.desc("bm25_score"), "id").limit(25).select("id", r6("bm25_score"))


@register("select w.term, count(*) as df, round(sum(1.0 / len), 6) as weight from (select list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')) as t, len(t) as len, unnest(t) as term from documents) w group by 1 having count(*) >= 20")
def postings_terms(spark, d):
    p = V.postings(W.notes(spark, d), "file_id", ["content"])
    return p.groupBy("term").agg(F.count("*").alias("df"), F.round(F.sum(F.lit(1.0) / F.col("length")), 6).alias("weight")).filter("df >= 20")


@register(
    "with tok as (select doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')) as t from documents), st as (select count(*) as n, avg(len(t)) as a from tok), "
    "p as (select doc_id, unnest(t) as term, len(t) as l from tok), df as (select term, count(*) as df from p group by 1), "
    "q as (select distinct item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) as term from benchmark), "
    "s as (select item_id as query, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * l / a))) as score from p join q using (term) join df using (term), st group by 1, 2) "
    "select query, doc_id, round(score, 6) as score from (select *, row_number() over (partition by query order by round(score, 6) desc, doc_id) as rn from s) where rn <= 5"
)
def multi_query_top5(spark, d):
    """Many queries against all documents at once: tiles of documents meet the queries' weights, then a top-k a query."""
    docs = W.load(spark, d, "documents").select("doc_id", "text")
    b = W.load(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.explode(text.index_tokens(F.col("text"))).alias("term"))
    return V.top_of_many(docs, "doc_id", "text", b, 5).select("query", F.col("id").alias("doc_id"), "score")


#: Names of parts with letters made CJK characters, so that whole tables of CJK text are searched.
_ABC, _HAN = "abcdefghijklmnopqrstuvwxyz", "红烧肉猫测试旅行天地人山水火木金土日月星风云雨雪花草"
_CJK = (
    f"cj as (select 'p' || p_partkey as id, translate(p_name, '{_ABC}', '{_HAN}') || case p_partkey % 3 when 0 then ' Ｐ９' when 1 then ' “v1”' else '' end as body from part), "
    "tk as (select id, regexp_extract_all(replace(lower(body), 'ｐ９', 'p9'), '[一-鿿]+|[a-z0-9_]+') as w from cj), "
    "ct as (select id, list_distinct(flatten([case when regexp_matches(x, '^[一-鿿]') then list_concat([substr(x, i, 1) for i in range(1, length(x) + 1)], [substr(x, i, 2) for i in range(1, length(x))]) else [x] end for x in w])) as terms, "
    "list_distinct(flatten([case when regexp_matches(x, '^[一-鿿]') and length(x) > 2 then [substr(x, i, 2) for i in range(1, length(x))] else [x] end for x in w])) as required from tk)"
)


def _cjk(spark, d):
    p = W.load(spark, d, "part")
    tail = F.expr("case p_partkey % 3 when 0 then ' Ｐ９' when 1 then ' “v1”' else '' end")
    return p.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.concat(F.translate("p_name", _ABC, _HAN), tail).alias("body"))


@register(f"with {_CJK} select id, list_sort(terms) as terms, list_sort(required) as required from ct")
def cjk_terms(spark, d):
    return _cjk(spark, d).select("id", F.array_sort(text.index_tokens(F.col("body"))).alias("terms"), F.array_sort(text.required_terms(F.col("body"))).alias("required"))


def cjk_sql(query: str) -> str:
    """CTEs up to scored(id, bm25_score, strict) over the CJK names."""
    required, terms = V.query_terms(query)
    stats = ", ".join(f"count(*) filter (list_contains(terms, '{t}')) as n{k}" for k, t in enumerate(terms))
    score = " + ".join(f"case when list_contains(terms, '{t}') then ln(1 + (n - n{k} + 0.5) / (n{k} + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(terms) / a)) else 0 end" for k, t in enumerate(terms))
    strict = " and ".join(f"list_contains(terms, '{t}')" for t in required)
    return f"{_CJK}, st as (select count(*) as n, avg(len(terms)) as a, {stats} from ct), scored as (select * from (select id, {score} as bm25_score, {strict} as strict from ct, st) where bm25_score > 0)"


_CJK_QUERY = "red bolt".translate(str.maketrans(_ABC, _HAN))


@register(f"with {cjk_sql(_CJK_QUERY)}, {staged_sql(25)} select id, stage, round(bm25_score, 6) as bm25_score, rank from staged")
def cjk_search(spark, d):
    return V.staged_search(_cjk(spark, d), "id", ["body"], _CJK_QUERY, 25).select("id", "stage", r6("bm25_score"), "rank")


@register(f"with {_CJK} select id, replace(replace(replace(body, 'Ｐ９', 'p9'), ' “v1”', ' \"v1'), 'x', 'x') as body from cj")
def cjk_normalised(spark, d):
    return _cjk(spark, d).select("id", text.normalize_search_text(F.col("body")).alias("body"))


_VQ = "q as (select embedding as e from embeddings where vec_id = 0)"
_COS = "list_cosine_similarity(embedding::double[], e::double[])"


def _query_vector(spark, d):
    return W.vectors(spark, d).filter("vec_id = 0").select("embedding").first()[0]


@register(f"with {_VQ} select 'm' || vec_id as id, round({_COS}, 6) as score from embeddings, q where round({_COS}, 6) >= 0.1 order by {_COS} desc, id limit 20")
def vector_topk(spark, d):
    return V.vector_top_k(W.vectors(spark, d), "id", "embedding", _query_vector(spark, d), 20, 0.1).select("id", r6("score"))


@register(f"with {_VQ} select 'm' || vec_id as id, round({_COS}, 6) as score from embeddings, q where round({_COS}, 6) >= 0.1 order by {_COS} desc, id limit 20")
def vector_topk_cells(spark, d):
    """The same search over vectors stored by cell."""
    cells = VectorCells.build(W.vectors(spark, d), "id", "embedding", f"{shared_folder(spark)}/cells")
    return cells.top_k(_query_vector(spark, d), 20, 0.1).select("id", r6("score"))


_FUSE = (
    f"{sql('mem')}, {_MT}, {bm25_sql('mt', 'id', _FIELDS, QUERY)}, {staged_sql(10)}, {_VQ}, v as (select 'm' || vec_id as id, {_COS} as score from embeddings, q order by score desc, id limit 30), "
    "b as (select *, row_number() over (order by bm25_score desc, id) as rb, count(*) over () as nb from staged), vv as (select *, row_number() over (order by score desc, id) as rv, count(*) over () as nv from v), "
    "j as (select coalesce(b.id, vv.id) as id, coalesce(rb, (select max(nb) from b) + 1) as x, coalesce(rv, (select max(nv) from vv) + 100) as y from b full join vv on b.id = vv.id), "
    "f as (select id, 1.0 / (60 + x) + 1.0 / (60 + y) as final_score from j) "
)


@register(_FUSE + "select id, round(final_score, 6) as final_score from f where final_score >= 0.5 * (select max(final_score) from f) order by f.final_score desc, id limit 15")
def rrf_fusion(spark, d):
    hits = V.staged_search(_mt(spark, d), "id", _FIELDS, QUERY, 10)
    v = V.vector_top_k(W.vectors(spark, d), "id", "embedding", _query_vector(spark, d), 30)
    return V.fuse(hits, v, 15).select("id", r6("final_score"))


_STRAT = f"{sql('mem')}, pool as (select * from mem where memory_scope in ('a', 'public')), mt as (select *, array_to_string(tags, ' ') as tags_text from pool), {bm25_sql('mt', 'id', _FIELDS, QUERY)}"


@register(_STRAT + f", {staged_sql(600)}, g as (select id, bm25_normalized_score as final_score from staged order by rank limit 600) select id, round(final_score, 6) as final_score from g where final_score >= 0.5 order by g.final_score desc, id limit 30")
def recall_by_tags(spark, d):
    return V.recall(W.memories(spark, d), QUERY, 30, "a").select("id", r6("final_score"))


_COMP = _STRAT + f", {staged_sql(600)}, g as (select s.id, bm25_normalized_score as fs, m.* exclude (id) from staged s join mem m using (id) where rank <= 600 and bm25_normalized_score >= 0.5 order by fs desc, id limit 30), c as (select *, case when is_active then fs else fs / (1 + 0.05 * greatest(({NOW} - created_at) / 86400.0, 0)) end as sim from g)"


@register(_COMP + " select id, round(sim, 6) as similarity from c order by sim desc, fs desc, id limit 10")
def time_decay_recall(spark, d):
    return V.comprehensive_recall(W.memories(spark, d), QUERY, 10, "a", NOW).select("id", r6("similarity"))


_POOL = (
    _STRAT + f", {staged_sql(6000)}, g as (select s.id, bm25_normalized_score as fs, m.* exclude (id) from staged s join mem m using (id) where rank <= 6000 and bm25_normalized_score >= 0.5 order by fs desc, id limit 300), "
    f"c as (select *, case when is_active then fs else fs / (1 + 0.05 * greatest(({NOW} - created_at) / 86400.0, 0)) end as sim from g), p as (select *, row_number() over (order by sim desc, id) as pos from (select * from c order by sim desc, fs desc, id limit 100)), "
)
_NAMES = "contains(lower(judgment || ' ' || array_to_string(tags, ' ')), "


@register(
    _POOL
    + "t as (select *, row_number() over (partition by memory_type order by pos) as rn, min(pos) over (partition by memory_type) as grp from p) select id, memory_type from t where rn <= 3 order by grp, pos limit 10"
)
def chained_recall(spark, d):
    return V.chained_recall(W.memories(spark, d), QUERY, [], 3, 10, "a", NOW).select("id", "memory_type")


@register(
    _POOL
    + f"e1 as (select * from p where {_NAMES} 'src1') order by pos limit 3), e2 as (select * from p where id not in (select id from e1) and {_NAMES} 'fr') order by pos limit 3), "
    "r as (select *, row_number() over (partition by memory_type order by pos) as rn, min(pos) over (partition by memory_type) as grp from p where id not in (select id from e1) and id not in (select id from e2)), "
    "o as (select id, 0 as a, 0 as b, pos as c from e1 union all select id, 0, 1, pos from e2 union all select id, 1, grp, pos from r where rn <= 3) "
    "select id, memory_type, round(sim, 6) as similarity from o join p using (id) order by a, b, c limit 10"
)
def chained_recall_entities(spark, d):
    return V.chained_recall(W.memories(spark, d), QUERY, ["src1", "fr"], 3, 10, "a", NOW).select("id", "memory_type", r6("similarity"))


@register(_STRAT + f", {staged_sql(600)}, g as (select s.id, bm25_normalized_score as fs from staged s where rank <= 600 and bm25_normalized_score >= 0.5 order by fs desc, id limit 30) select id, round(fs, 6) as final_score from g join mem using (id) where memory_type = '事件记忆'")
def recall_by_type(spark, d):
    return V.recall_by_type(W.memories(spark, d), QUERY, 30, "a", "事件记忆").select("id", r6("final_score"))


@register(
    _STRAT + f", {staged_sql(200)}, {_VQ}, v as (select 'm' || vec_id as id, {_COS} as score from embeddings, q order by score desc, id limit 30), "
    "c as (select id from v union select id from staged), r as (select c.id, length(coalesce(pool.judgment, c.id)) as l from c left join pool using (id)), f as (select id, l / (max(l) over ())::double as final_score from r) "
    "select id, round(final_score, 6) as final_score, 'rerank' as score_kind from f where f.final_score >= 0.5 and id in (select id from pool) order by f.final_score desc, id limit 10"
)
def recall_reranked(spark, d):
    v = V.vector_top_k(W.vectors(spark, d), "id", "embedding", _query_vector(spark, d), 30)
    length = lambda q, docs: [float(len(x)) for x in docs]
    return V.recall(W.memories(spark, d), QUERY, 10, "a", v, length).select("id", r6("final_score"), "score_kind")


@register(f"{sql('mem')} select id, id = 'm5' as first from mem where id in ('m5', 'm3', 'm9', 'm4') and memory_scope in ('a', 'public')")
def ordered_lookup(spark, d):
    return V.ordered_lookup(W.memories(spark, d), ["m5", "m3", "m9", "m3", "m4", "gone"], "a").select("id", (F.col("id") == "m5").alias("first"))


def _chunks(spark, d):
    return N.chunk_notes(W.notes(spark, d))


def _stored_chunks(spark, d):
    """Documents as the chunks of a few files."""
    return W.load(spark, d, "documents").select(
        F.expr("coalesce(source, 'none') || '/' || (doc_id % 40) || '.md'").alias("file_id"), F.expr("coalesce(source, 'none') || '/' || (doc_id % 40) || '.md'").alias("source_file_path"),
        F.col("doc_id").alias("chunk_index"), F.coalesce("text", F.lit("")).alias("content"),
    )


_SC = "sc as (select file_id || '#' || doc_id as id, file_id, file_id as source_file_path, doc_id as chunk_index, content from (select coalesce(source, 'none') || '/' || (doc_id % 40) || '.md' as file_id, doc_id, coalesce(text, '') as content from documents))"


def note_sql(terms: list[str], limit: int, per_file: int = 2) -> str:
    """CTEs up to found(id, file_id, matched, score), ordered by matched, score and id."""
    n = limit if len(terms) == 1 else max(3 * limit, 50)
    files, parts = max(n, V.LEAST_FILES), [_SC]
    for k, t in enumerate(terms):
        each = bm25_sql("sc", "id", ["content", "source_file_path"], t).replace("tok as", f"tok{k} as").replace("from tok)", f"from tok{k})").replace("from tok, st", f"from tok{k}, st{k}")
        parts.append(each.replace("st as (", f"st{k} as (").replace("scored as", f"scored{k} as"))
    union = " union all ".join(f"select {k} as q, id, bm25_score, strict from scored{k}" for k in range(len(terms)))
    ceiling = " ".join(f"when {k} then {V.fetch_ceiling(t, n)}" for k, t in enumerate(terms))
    order = "stage, bm25_score desc, id"
    parts += [
        f"h0 as (select u.*, file_id, case when strict then 0 else 1 end as stage from ({union}) u join sc using (id))",
        f"h1 as (select * from (select *, row_number() over (partition by q, stage order by bm25_score desc, id) as rn from h0) where rn <= case q {ceiling} end)",
        f"h2 as (select * from (select * exclude (rn), row_number() over (partition by q, file_id order by {order}) as rn from h1) where rn <= {per_file})",
        f"h3 as (select *, sum((rn = 1)::int) over (partition by q order by {order} rows between unbounded preceding and 1 preceding) as so_far, row_number() over (partition by q order by {order}) as place from h2)",
        f"h4 as (select * from h3 where coalesce(so_far, 0) < {files} and place <= {n})",
        "h5 as (select id, file_id, count(distinct q) as matched, max(bm25_score) as score from h4 group by 1, 2)",
        f"found as (select * from (select *, row_number() over (partition by file_id order by matched desc, score desc, id) as rn from h5) where rn <= {per_file})",
    ]
    return "with " + ", ".join(parts)


@register(note_sql(["the", "benchmark", "with"], 20) + " select id, file_id, matched, round(score, 6) as score from found order by matched desc, found.score desc, id limit 20")
def note_search_terms(spark, d):
    return V.note_search(_stored_chunks(spark, d), "the benchmark|with", 20).select("id", "file_id", "matched", r6("score"))


@register(note_sql(["und"], 30) + " select id, file_id, round(score, 6) as score from found order by found.score desc, id limit 30")
def note_search_one(spark, d):
    return V.note_search(_stored_chunks(spark, d), "und", 30).select("id", "file_id", r6("score"))


@register(note_sql(["the", "with"], 10) + ", r as (select id, file_id, length(content) as l from found join sc using (id, file_id)) select id, file_id, round(l / (max(l) over ())::double, 6) as score from r order by l desc, id limit 10")
def note_search_reranked(spark, d):
    length = lambda q, docs: [float(len(x)) for x in docs]
    return V.note_search(_stored_chunks(spark, d), "the with", 10, scorer=length).select("id", "file_id", r6("score"))


#: The notes after a sync: every fifth file is gone, every third of the others has new text.
_EDITED = "try_cast(split_part(split_part(file_id, '/', 2), '.', 1) as int)"
_SYNCED = _SC + f", synced as (select * replace (case when {_EDITED} % 3 = 0 then 'edited benchmark ' || content || ' und' else content end as content) from sc where {_EDITED} % 5 <> 0)"


@register(note_sql(["the", "edited", "und"], 20).replace(_SC, _SYNCED).replace("from sc)", "from synced)").replace("join sc using", "join synced using") + " select id, file_id, matched, round(score, 6) as score from found order by matched desc, found.score desc, id limit 20")
def note_index_search(spark, d):
    """A search over the stored index after files were replaced and deleted, before and after its segments became one."""
    chunks = _stored_chunks(spark, d)
    number = F.element_at(F.split(F.element_at(F.split("file_id", "/"), 2), "\\."), 1).try_cast("int")
    edited = chunks.filter((number % 3 == 0) & (number % 5 != 0)).withColumn("content", F.concat(F.lit("edited benchmark "), "content", F.lit(" und")))
    gone = chunks.filter(number % 5 == 0).select("file_id")
    first = ChunkIndex(spark, f"{shared_folder(spark)}/chunk-index-{uuid.uuid4().hex}").build(chunks)
    index = first.replace(edited, gone).compact()
    now = chunks.join(gone.distinct(), "file_id", "left_anti").join(edited.select("file_id").distinct(), "file_id", "left_anti").unionByName(edited)
    found = cut_lineage(V.note_search(now, "the|edited|und", 20, index=index).select("id", "file_id", "matched", r6("score")))
    index.remove()
    return found


@register(note_sql(["the", "with"], 50) + ", top as (select * from found order by matched desc, score desc, id limit 50), hits as (select top.*, row_number() over (order by matched desc, score desc, top.id) as rank from top join sc using (id) where contains(lower(content), 'the') or contains(lower(content), 'with')) select file_id as source_file_path, row_number() over (order by min(rank)) as place, string_agg(id, ',' order by rank) as chunk_ids from hits group by 1")
def recall_tool_notes(spark, d):
    """Notes as the recall tool shows them: found, filtered by their content, grouped by file."""
    found = V.note_search(_stored_chunks(spark, d), "the with", 50)
    found = found.filter(text.contains_any_part(F.col("content"), F.lit("the with")))
    rank = F.row_number().over(Window.orderBy(F.desc("matched"), F.desc("score"), "id"))
    return N.by_file(found.withColumn("rank", rank))


@register(
    _COMP.replace(staged_sql(600), staged_sql(3000)).replace("rank <= 600", "rank <= 3000").replace("limit 30)", "limit 150)")
    + ", s as (select id, memory_type, sim, fs, is_active from c order by sim desc, fs desc, id limit 50), a as (select *, row_number() over (order by sim desc, fs desc, id) as rank from s where is_active) select id, memory_type, rank, min(rank) over (partition by memory_type) as place from a"
)
def recall_tool_memories(spark, d):
    """Memories as the recall tool shows them: active ones of fifty, by type."""
    return V.active_recall(W.memories(spark, d), QUERY, "a", NOW, 50).select("id", "memory_type", "rank", "place")


@register(f"with {_VQ}, v as (select vec_id, {_COS} as s from embeddings, q order by s desc, vec_id limit 25) select doc_id, round(s, 6) as score, round(1.0 - s, 6) as distance, row_number() over (order by s desc, 'm' || vec_id) - 1 + 100 as vector_id, length(text) as chars from v join documents on doc_id = vec_id".replace("order by s desc, vec_id limit 25", "order by s desc, 'm' || vec_id limit 25"))
def vector_documents(spark, d):
    docs = W.load(spark, d, "documents").select(F.concat(F.lit("m"), "doc_id").alias("id"), "doc_id", F.char_length("text").alias("chars"))
    found = V.vector_documents(W.vectors(spark, d), docs, "id", "embedding", _query_vector(spark, d), 25, offset=100)
    return found.select("doc_id", r6("score"), r6("distance"), "vector_id", "chars")


@register("select label, vec_id, rank from (select label, vec_id, row_number() over (partition by label order by vec_id) as rank from embeddings where label is not null) where rank <= 2")
def per_file_cap(spark, d):
    e = W.load(spark, d, "embeddings").filter("label is not null").select("label", "vec_id", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("rank"))
    return R.quota(e, ["label"], [F.col("rank")], 2)


@register("with r as (select vec_id as rank, cast(label as varchar) as file_id from embeddings), c as (select * from (select *, row_number() over (partition by file_id order by rank) as rn from r) where rn <= 2), f as (select *, coalesce(sum((rn = 1)::int) over (order by rank rows between unbounded preceding and 1 preceding), 0) as so_far from c) select file_id, rank from f where so_far < 3")
def notes_until_files(spark, d):
    e = W.load(spark, d, "embeddings").select(F.col("vec_id").alias("rank"), F.col("label").cast("string").alias("file_id"))
    return V.notes_until_files(e, 3, 2).select("file_id", "rank")


@register(f"{sql('mem')} select id as item_id, trim(judgment) || ' ' || array_to_string(tags, ' ') as vector_text from mem")
def vector_index_rows(spark, d):
    return store.vector_index_rows(W.memories(spark, d))


_DIFF_T = "select case when doc_id % 5 = 1 then 'n' else 'm' end || doc_id as item_id, coalesce(text, 'none') as vector_text from documents"
_DIFF_I = "select case when doc_id % 4 = 3 then 'o' else 'm' end || doc_id as item_id, case when doc_id % 7 = 2 then 'old' else coalesce(text, 'none') end as vector_text from documents"


@register(f"with t as ({_DIFF_T}), i as ({_DIFF_I}) select coalesce(t.item_id, i.item_id) as item_id, case when i.item_id is null then 'missing' when t.item_id is null then 'orphan' else 'changed' end as change from t full join i on t.item_id = i.item_id where (t.item_id is null or i.item_id is null or t.vector_text <> i.vector_text) and coalesce(t.vector_text, 'x') <> ''")
def vector_sync_diff(spark, d):
    doc = W.load(spark, d, "documents").withColumn("t", F.coalesce("text", F.lit("none")))
    truth = doc.select(F.expr("case when doc_id % 5 = 1 then 'n' else 'm' end || doc_id").alias("item_id"), F.col("t").alias("vector_text"))
    index = doc.select(F.expr("case when doc_id % 4 = 3 then 'o' else 'm' end || doc_id").alias("item_id"), F.when(F.expr("doc_id % 7 = 2"), "old").otherwise(F.col("t")).alias("vector_text"))
    return V.vector_diff(truth, index)


# ---------------------------------------------------------------- lifecycle

_TIER = "case when useful_score >= 10 then 2 when useful_score >= 3 then 1 else 0 end"
_REC = ", ".join(REC)


def _ids(spark, d, event: str):
    e = W.load(spark, d, "events").filter(F.col("event_type") == event)
    return e.select(F.concat(F.lit("m"), F.floor(F.col("value") / 2) if event == "purchase" else F.col("user_id") % 1000).alias("id")).distinct()


_USEFUL = "useful as (select distinct 'm' || floor(value / 2)::bigint as id from events where event_type = 'purchase')"
_RECALLED = "recalled as (select distinct 'm' || (user_id % 1000) as id from events where event_type = 'click')"


@register(f"{sql('mem')} select {_TIER} as tier, count(*) as n, sum(strength)::bigint as strength from mem group by 1")
def tier_histogram(spark, d):
    return L.tier_histogram(W.memories(spark, d))


_DECAYED = (
    f"ref as (select *, case when last_decay_at > 0 then last_decay_at else greatest(last_recalled_at, created_at) end as ref from mem), "
    f"st as (select *, case when not is_active and {_TIER} = 0 then greatest(0, trunc(({NOW} - ref) / 259200.0))::bigint else 0 end as steps from ref), "
    "dec as (select id, judgment, greatest(0, strength - steps)::int as strength, useful_count, useful_score, last_recalled_at, case when steps > 0 then ref + steps * 259200.0 else last_decay_at end as last_decay_at, is_active from st)"
)


@register(f"{sql('mem')}, {_DECAYED} select {_REC} from dec")
def t0_decay(spark, d):
    return L.natural_decay(W.memories(spark, d), NOW).select(*REC)


@register(f"{sql('mem', 'dim', 'rel')}, {_DECAYED} select (select count(*) from dec where is_active or strength > 0) as records, (select count(*) from rel where memory_id in (select id from dec where is_active or strength > 0)) as links")
def consolidate(spark, d):
    m = W.memories(spark, d)
    dim = store.tag_dimension(m)
    _, rel = store.bind_tags(dim.filter(F.lit(False)), spark.createDataFrame([], "memory_id string, tag_id long"), m)
    kept, links = L.consolidate(m, rel, NOW)
    return kept.agg(F.count("*").alias("records")).crossJoin(links.agg(F.count("*").alias("links")))


@register(f"{sql('mem')}, {_USEFUL} select id, judgment, (strength + (u.id is not null)::int)::int as strength, (useful_count + (u.id is not null)::int)::int as useful_count, useful_score + case when u.id is not null then 2.5 else 0 end as useful_score, case when u.id is not null then {NOW} else last_recalled_at end as last_recalled_at, last_decay_at from mem left join (select id as uid, id from useful) u on mem.id = u.uid".replace("select id, judgment", "select mem.id, judgment"))
def reinforce(spark, d):
    return L.reinforce(W.memories(spark, d), _ids(spark, d, "purchase"), NOW).select(*REC)


@register(f"{sql('mem')}, {_RECALLED} select mem.id, judgment, case when r.id is not null and not is_active and {_TIER} = 1 then greatest(0, strength - 1) else strength end::int as strength, useful_count, useful_score, last_recalled_at, last_decay_at from mem left join recalled r on mem.id = r.id")
def useless_decay(spark, d):
    return L.useless_decay(W.memories(spark, d), _ids(spark, d, "click")).select(*REC)


@register(
    f"{sql('mem')}, {_USEFUL}, {_RECALLED}, r1 as (select mem.id, is_active, judgment, strength + (u.id is not null)::int as strength, useful_score + case when u.id is not null then 2.5 else 0 end as useful_score from mem left join useful u on mem.id = u.id), "
    f"w as (select id from recalled where id not in (select id from useful)) select r1.id, case when w.id is not null and not is_active and {_TIER} = 1 then greatest(0, strength - 1) else strength end::int as strength, useful_score from r1 left join w on r1.id = w.id"
)
def feedback_no_actions(spark, d):
    acts = spark.createDataFrame([], "action_no int, action string, source_memory_ids array<string>, memory struct<type:string,judgment:string,reasoning:string,tags:array<string>>")
    return L.feedback(W.memories(spark, d).drop("tags"), _ids(spark, d, "purchase"), _ids(spark, d, "click"), acts, NOW).select("id", "strength", "useful_score")


@register(
    f"{sql('mem')}, g as (select mem.*, 'g' || (substr(id, 2)::bigint // 3) as group_id, substr(id, 2)::bigint as pos from mem where memory_scope <> 'b') "
    "select group_id, sum(strength)::int as strength, sum(useful_count)::int as useful_count, max(useful_score) as useful_score, max(last_recalled_at) as last_recalled_at, min_by(judgment, pos) as judgment, coalesce(min(case when memory_scope <> 'public' then memory_scope end), 'public') as memory_scope from g group by 1 having count(*) >= 2"
)
def merge_groups(spark, d):
    m = W.memories(spark, d)
    n = F.substring(F.col("id"), 2, 20).cast("long")
    g = m.filter("memory_scope <> 'b'").select(F.concat(F.lit("g"), F.floor(n / 3)).alias("group_id"), "id", n.alias("pos"))
    return L.merge_groups(m, g).select("group_id", "strength", "useful_count", "useful_score", "last_recalled_at", "judgment", "memory_scope")


@register(
    f"{sql('mem')}, inc as (select judgment, 'n' || id as id, created_at + case when strength % 2 = 0 then 10000000 else -10000000 end as created_at, strength + 1 as strength from mem where strength % 3 = 0 union all select 'new ' || id, 'x' || id, created_at, strength from mem where strength = 5), "
    "l as (select * from (select *, row_number() over (partition by judgment order by created_at desc, id desc) as rn from inc) where rn = 1), s as (select * from (select *, row_number() over (partition by judgment order by created_at desc, updated_at desc, id) as rn from mem where judgment in (select judgment from l)) where rn = 1) "
    "select l.judgment, case when s.id is null then l.id else s.id end as id, (case when s.id is null or l.created_at >= s.created_at then l.strength else s.strength end)::int as strength, case when s.id is null then 'inserted' when l.created_at >= s.created_at then 'updated' else 'skipped' end as outcome from l left join s using (judgment) "
    "union all select judgment, id, strength, 'kept' from mem where judgment not in (select judgment from l)"
)
def judgment_upsert(spark, d):
    m = W.memories(spark, d).select("judgment", "id", "created_at", "updated_at", "strength")
    shift = F.when(F.expr("strength % 2 = 0"), 1e7).otherwise(-1e7)
    a = m.filter("strength % 3 = 0").select("judgment", F.concat(F.lit("n"), "id").alias("id"), (F.col("created_at") + shift).alias("created_at"), F.lit(NOW).alias("updated_at"), (F.col("strength") + 1).cast("int").alias("strength"))
    b = m.filter("strength = 5").select(F.concat(F.lit("new "), "id").alias("judgment"), F.concat(F.lit("x"), "id").alias("id"), "created_at", F.lit(NOW).alias("updated_at"), "strength")
    inc = a.unionByName(b).withColumn("seq", F.col("id"))
    return L.upsert_by_judgment(m, inc).select("judgment", "id", "strength", "outcome")


@register(f"{sql('mem')} select id, (case when memory_type = '任务记忆' and memory_scope = 'a' and id <> 'm13' then 1 else strength end)::int as strength from mem")
def demote_tasks(spark, d):
    return L.demote_tasks(W.memories(spark, d), "m13", "a").select("id", "strength")


@register(f"{sql('mem')} select id, trim(coalesce(nullif(case when strength % 4 = 0 then ' ' else memory_scope end, ' '), 'public')) as memory_scope from mem")
def scope_backfill(spark, d):
    m = W.memories(spark, d).withColumn("memory_scope", F.when(F.expr("strength % 4 = 0"), " ").otherwise(F.col("memory_scope")))
    return store.backfill_scope(m).select("id", "memory_scope")


@register("select c, f, greatest(1.0, round_even(greatest(c, 1.0) / (greatest(f, 0.01) * 1.0), 0))::bigint as days from (select (l_linenumber * 1.5)::double as c, (l_quantity / 10)::double as f from lineitem) group by 1, 2")
def decay_cycle_days(spark, d):
    x = W.load(spark, d, "lineitem").select((F.col("l_linenumber") * 1.5).cast("double").alias("c"), (F.col("l_quantity") / 10).cast("double").alias("f")).distinct()
    return x.select("c", "f", scoring.cycle_days(F.col("c"), F.col("f"), F.lit(1.0)).alias("days"))


# ---------------------------------------------------------------- store


@register(f"{sql('mem', 'dim')} select id, name from dim")
def tag_dimension(spark, d):
    return store.tag_dimension(W.memories(spark, d))


def _tags(spark, d):
    m = W.memories(spark, d)
    dim = store.tag_dimension(m)
    _, rel = store.bind_tags(dim, spark.createDataFrame([], "memory_id string, tag_id long"), m)
    return m, dim, rel


@register(f"{sql('mem', 'dim', 'rel')} select memory_id, tag_id from rel")
def tag_links(spark, d):
    return _tags(spark, d)[2]


@register(f"{sql('mem')} select id, array_to_string(list_sort(list_distinct(tags)), ', ') as tags from mem")
def tags_concat(spark, d):
    m, dim, rel = _tags(spark, d)
    return store.with_tags(m.drop("tags"), dim, rel).select("id", F.array_join("tags", ", ").alias("tags"))


@register(f"{sql('mem', 'dim', 'rel')} select dim.id, name, count(memory_id) as memory_count from dim left join rel on rel.tag_id = dim.id group by 1, 2")
def tag_counts(spark, d):
    _, dim, rel = _tags(spark, d)
    return browse.tag_counts(dim, rel)


@register(f"{sql('mem', 'dim', 'rel')}, h as (select memory_id as id, count(distinct tag_id) as hit_count from rel where tag_id in (select id from dim where contains('long notes in fr from src1', lower(name))) group by 1) select id, hit_count, strength from mem join h using (id) where memory_scope in ('a', 'public') order by hit_count desc, strength desc, created_at desc, id limit 40")
def tag_hit_search(spark, d):
    m, dim, rel = _tags(spark, d)
    return browse.tag_hits(m, dim, rel, "long notes in FR from src1", "a", 40).select("id", "hit_count", "strength")


@register(f"{sql('mem', 'dim', 'rel')} select count(*) as records, count(*) filter (is_active) as active, array_to_string(list_sort(list_distinct(list(memory_scope))), ',') as scopes, (select count(*) from dim) as tags, (select count(*) from rel) as links from mem")
def overview(spark, d):
    return browse.overview(*_tags(spark, d))


@register(f"{sql('mem')} select id, judgment from mem where judgment ilike '%the%' or reasoning ilike '%the%' or array_to_string(tags, '|') ilike '%the%'")
def keyword_filter(spark, d):
    return browse.keyword_filter(W.memories(spark, d), "the").select("id", "judgment")


@register(f"{sql('mem')} select id, created_at, strength from mem where memory_scope in ('b', 'public') order by created_at desc, strength desc, id limit 20 offset 40")
def browse_page(spark, d):
    m = W.memories(spark, d).filter(V.scope_filter("b"))
    return R.page(m, [F.desc("created_at"), F.desc("strength"), F.col("id")], 3, 20).select("id", "created_at", "strength")


@register(f"{sql('mem')} select count(*) as total, 3 as page, 20 as page_size, greatest(1, ceil(count(*) / 20.0))::bigint as total_pages from mem where memory_scope in ('b', 'public')")
def browse_page_info(spark, d):
    return R.page_info(W.memories(spark, d).filter(V.scope_filter("b")), 3, 20)


@register(f"{sql('mem')}, o as (select id, row_number() over (order by created_at desc, id) as rn from mem) select id, (select count(*) from o where rn <= 500) > 50 as has_more from o where rn between 26 and 50")
def has_more_page(spark, d):
    return R.has_more_page(W.memories(spark, d), [F.desc("created_at"), F.col("id")], 2, 25).select("id", "has_more")


@register(f"{sql('mem')} select id, 9999 + row_number() over (order by created_at, id) as short_id from mem")
def ordinal_ids(spark, d):
    return store.ordinal_ids(W.memories(spark, d))


@register(f"{sql('mem')} select id, substr(md5(id), 1, 8) as short_id, trunc(created_at / 86400)::bigint as day from mem")
def short_hash_day(spark, d):
    return W.memories(spark, d).select("id", text.short_hash(F.col("id")).alias("short_id"), text.day_bucket(F.col("created_at")).alias("day"))


@register(f"{sql('mem')}, inc as (select case when strength % 2 = 0 then id else 'n' || id end as id, case when strength = 7 then '' else judgment end as j from mem) select count(*) filter (j <> '' and trim(j) <> '' and id not in (select id from mem)) as inserted, count(*) filter (trim(j) <> '' and id in (select id from mem)) as skipped, count(*) filter (trim(j) = '') as failed from inc")
def snapshot_import_counts(spark, d):
    m = W.memories(spark, d).drop("tags")
    inc = m.withColumn("id", F.when(F.expr("strength % 2 = 0"), F.col("id")).otherwise(F.concat(F.lit("n"), F.col("id")))).withColumn("judgment", F.when(F.col("strength") == 7, "").otherwise(F.col("judgment")))
    return store.import_snapshot(m, inc)[1]


def _snapshot_files(spark, d) -> str:
    """All memories as JSON snapshots in the shared folder, more of them the more there are."""
    path, m = f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}", W.memories(spark, d)
    snapshots.write_snapshot({"global_tags": store.tag_dimension(m), "records": m}, path, 1 + m.count() // 50_000)
    return path


@register(f"{sql('mem')} select id, memory_type, judgment, reasoning, strength, is_active, useful_count, useful_score, last_recalled_at, last_decay_at, created_at, updated_at, memory_scope, array_to_string(tags, '|') as tags from mem")
def snapshot_files(spark, d):
    """Every memory written to JSON snapshots and read from them again in splits."""
    read = snapshots.read_snapshot(spark, _snapshot_files(spark, d))
    return read.withColumn("tags", F.array_join("tags", "|")).select(*[c for c in W.MEM if c != "tags"], "tags")


@register(f"{sql('mem')} select count(*) as records, count(*) filter (is_active) as active from mem")
def backup_preview(spark, d):
    return files.preview_backup(spark, _snapshot_files(spark, d))


# ---------------------------------------------------------------- profiles

_PV = "pv as (select *, tags[1] as user_id, tags[2] as attribute, tags[3] as nickname from prof where tags[2] <> 'other')"


@register(f"{sql('prof')}, {_PV}, r as (select *, row_number() over (partition by user_id order by is_active desc, updated_at desc, id) as rn from pv where memory_scope in ('a', 'public') and user_id in ('000000001', '000000002', '000000004', '000000010')) select id, user_id, attribute from r where rn <= 5")
def profile_recall(spark, d):
    return browse.profile_recall(W.profile_memories(spark, d), ["000000001", "000000002", "000000004", "000000010"], "a", 5).select("id", "user_id", "attribute")


@register(f"{sql('prof')}, {_PV}, a as (select user_id, attribute, count(*) as n from pv group by 1, 2), n as (select user_id, arg_max(nickname, [lpad(cast(updated_at::bigint as varchar), 8, '0'), id]) filter (nickname <> '') as nickname from pv group by 1), b as (select user_id, sum(n)::bigint as memory_count, string_agg(attribute || ':' || n, ',' order by attribute || ':' || n) as attributes from a group by 1) select user_id, memory_count, attributes, coalesce(nickname, '') as nickname from b left join n using (user_id)")
def profile_stats(spark, d):
    return browse.profile_stats(W.profile_memories(spark, d)).select("user_id", "memory_count", "attributes", "nickname")


@register(f"{sql('prof')} select id, tags[1] as user_id, case when tags[2] = 'other' then '' else tags[2] end as attribute, tags[2] <> 'other' as is_profile from prof")
def profile_tags(spark, d):
    p = W.profile_memories(spark, d)
    return p.select("id", T.user_id(F.col("tags")).alias("user_id"), T.profile_attribute(F.col("tags")).alias("attribute"), T.is_profile(F.col("tags")).alias("is_profile"))


@register(f"{sql('prof')} select id from prof where tags[2] <> 'other'")
def profile_pair_join(spark, d):
    p = W.profile_memories(spark, d)
    dim = store.tag_dimension(p)
    _, rel = store.bind_tags(dim, spark.createDataFrame([], "memory_id string, tag_id long"), p)
    return browse.tag_pair_memories(dim, rel)


# ---------------------------------------------------------------- notes and files


@register(f"{sql('idx', 'disk')} select coalesce(i.relative_path, d.relative_path) as relative_path, case when d.relative_path is null then 'delete' when i.relative_path is null or d.file_timestamp > i.file_timestamp then 'add' else 'unchanged' end as change from idx i full join disk d on i.relative_path = d.relative_path")
def file_diff(spark, d):
    return N.file_diff(W.file_index(spark, d), W.disk_files(spark, d))


@register(f"{sql('idx', 'disk')} select i.relative_path, greatest(i.file_timestamp, coalesce(d.file_timestamp, i.file_timestamp)) as file_timestamp from idx i left join disk d on i.relative_path = d.relative_path")
def file_timestamps(spark, d):
    return N.bump_timestamps(W.file_index(spark, d), W.disk_files(spark, d))


#: Line states by gaps and islands: a bare fence swaps inside and outside, a fence with a name leads inside; text is then cut by a recursion over its pieces.
_CHUNKED = (
    "ln as (select file_id, source_file_path as path, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) as n from note), "
    f"l1 as (select *, starts_with(line, '```') as fence, starts_with(line, '```') and regexp_matches(substr(line, 4), '{N.BLANK}') as bare, starts_with(line, '|') as tab, regexp_matches(line, '{N.BLANK}') as blank, length(line) as len from ln), "
    "l2 as (select *, sum(bare::int) over (partition by file_id order by n) as bares from l1), "
    "l3 as (select *, coalesce(bares - last_value(case when fence and not bare then bares end ignore nulls) over (partition by file_id order by n) + 1, bares) % 2 = 1 as inside from l2), "
    "l4 as (select *, coalesce(lag(inside) over (partition by file_id order by n), false) as before from l3), "
    "l5 as (select *, case when before or fence then 'code' when tab then 'row' when blank then 'none' else 'text' end as kind from l4), "
    "l6 as (select *, case when kind = 'code' then not before else kind <> 'none' and kind is distinct from lag(kind) over (partition by file_id order by n) end as begins from l5), "
    "l7 as (select *, sum(begins::int) over (partition by file_id order by n) as g from l6), "
    "l8 as (select *, sum(len) over (partition by file_id, g order by n) as upto from l7 where kind <> 'none'), "
    f"cut as (select file_id, g, n, upto - len as off from l8 where begins union all select c.file_id, c.g, x.n, x.upto - x.len from cut c, lateral (select n, upto, len from l8 t where t.file_id = c.file_id and t.g = c.g and t.kind = 'text' and t.n > c.n and t.upto - c.off > {N.MAX_CHUNK_CHARS} order by n limit 1) x), "
    "piece as (select l8.file_id, path, l8.n, line, (select max(c.n) from cut c where c.file_id = l8.file_id and c.g = l8.g and c.n <= l8.n) as a from l8), "
    "span as (select file_id, any_value(path) as path, a, max(n) as b, string_agg(line, chr(10) order by n) as body, row_number() over (partition by file_id order by a) as k from piece group by file_id, a), "
    "chunk as (select file_id, path as source_file_path, k::int as chunk_index, (case when k = 1 then 0 else a end)::int as line_start, b::int as line_end, case when k = 1 then path || chr(10) || body else body end as content from span "
    "union all select file_id, source_file_path, 1, 0, 0, source_file_path from note where file_id not in (select file_id from span))"
)


@register(f"{sql('note').replace('with ', 'with recursive ', 1)}, {_CHUNKED} select file_id, source_file_path, chunk_index, line_start, line_end, content from chunk")
def chunk_documents(spark, d):
    return _chunks(spark, d)


@register(f"{sql('note').replace('with ', 'with recursive ', 1)}, {_CHUNKED} select count(*)::bigint as total_chunks, count(distinct file_id)::bigint as total_files from chunk")
def chunk_stats(spark, d):
    return N.chunk_stats(_chunks(spark, d))


_LINES = "lines as (select file_id, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) as line_no from note)"


@register(f"{sql('note')}, {_LINES} select file_id, line_no, line from lines where line_no between 3 and 7")
def line_page(spark, d):
    return N.line_page(W.notes(spark, d), 2, 5)


@register(f"{sql('note')}, {_LINES}, p as (select *, sum(length(line) + 1) over w as used, row_number() over w as k from lines where line_no between 1 and 2000 window w as (partition by file_id order by line_no rows unbounded preceding)), t as (select file_id, max(line_no) as n from lines group by 1) select p.file_id, line_no, line, max(line_no) over (partition by p.file_id) < n as has_more from p join t using (file_id) where used <= 900 or k = 1")
def char_budget_page(spark, d):
    return N.budget_page(W.notes(spark, d), 0, 2000, 900)


@register(f"{sql('note')} select file_id, len(string_split(content, chr(10))) - (content like '%' || chr(10))::int as total_lines from note where content <> ''")
def note_line_counts(spark, d):
    return N.note_facts(W.notes(spark, d).filter("content <> ''")).select("file_id", "total_lines")


@register(
    "with note as (select coalesce(source, 'none') || '/' || doc_id || '.md' as file_id, '# A' || chr(10) || '## B' || chr(10) || coalesce(text, '') as content from documents), "
    + _LINES
    + ", h as (select *, regexp_extract(line, '^(#{1,6}) +(.*)$', 1) as hs, regexp_extract(line, '^(#{1,6}) +(.*)$', 2) as ht from lines) "
    "select file_id, line_no, last_value(case when hs <> '' then ht end ignore nulls) over w as section, last_value(case when hs <> '' then length(hs)::int end ignore nulls) over w as section_level from h window w as (partition by file_id order by line_no rows unbounded preceding)"
)
def note_sections(spark, d):
    n = W.notes(spark, d).withColumn("content", F.concat(F.lit("# A\n## B\n"), F.col("content")))
    return N.sections(n).select("file_id", "line_no", "section", "section_level")


# ---------------------------------------------------------------- chat


@register(f"{sql('chat')} select session, seq from chat where length(trim(coalesce(content, ''))) >= 5 and not starts_with(trim(content), '/') and not is_processed")
def message_gate(spark, d):
    return C.unprocessed(C.gate(W.chat(spark, d))).select("session", "seq")


@register(f"{sql('chat')} select session, seq from (select *, row_number() over (partition by session, role, sender_id, round(ts, 6), content order by seq) as rn from (select * from chat union all select * from chat where seq % 2 = 0)) where rn = 1")
def chat_dedupe(spark, d):
    c = W.chat(spark, d)
    return C.dedupe(c.unionByName(c.filter("seq % 2 = 0"))).select("session", "seq")


@register(f"{sql('chat')} select session, sender_id, sender_name from (select *, row_number() over (partition by session, sender_id order by seq) as rn from chat) where rn = 1")
def participants(spark, d):
    return C.participants(W.chat(spark, d)).select("session", "sender_id", "sender_name")


@register(f"{sql('chat')} select session, sender_id, min(seq) as first_seq, coalesce(max_by(sender_name, seq) filter (sender_name <> ''), '') as latest_name from chat where role = 'user' and sender_id <> '' group by 1, 2")
def chat_users(spark, d):
    return C.users(W.chat(spark, d))


@register(f"{sql('chat')} select session, seq from chat where sender_id <> '' or sender_name <> ''")
def identity_filter(spark, d):
    return W.chat(spark, d).filter(C.identified(F.col("sender_id"), F.col("sender_name"))).select("session", "seq")


@register(f"{sql('chat')} select session, max_by(content, seq) as content from chat where not is_processed group by 1")
def last_unprocessed(spark, d):
    return C.last_unprocessed(W.chat(spark, d))


@register(f"{sql('chat')}, l as (select session, seq, ts, coalesce(ts - lag(ts) over (partition by session order by ts, seq) >= 600, false) as gap from chat), r as (select *, sum(gap::int) over (partition by session order by ts, seq) as run from l), k as (select *, (row_number() over (partition by session, run order by ts, seq) - 1) // 6 as k from r) select session, seq, dense_rank() over (partition by session order by run, k) as batch_no, case when count(*) over (partition by session, run, k) = 6 then 'count' else 'idle' end as trigger from k")
def reflection_batches(spark, d):
    return C.reflection_batches(W.chat(spark, d)).select("session", "seq", "batch_no", "trigger")


_AGE = "case when d < 60 then '刚刚' when d < 3600 then floor(d / 60)::bigint || '分钟前' when d < 86400 then floor(d / 3600)::bigint || '小时前' else floor(d / 86400)::bigint || '天前' end"


@register(
    f"{sql('chat')}, l as (select session, seq, '[' || sender_id || '] ' || sender_name || ' (' || {_AGE} || '): ' || content as line from (select *, {NOW} - ts as d from chat) "
    "where not (contains(content, 'tool_call') or contains(content, 'function_call') or contains(content, 'tool_use') or contains(content, '工具调用'))) select session, string_agg(line, chr(10) order by seq) as lines from l group by 1"
)
def chat_lines(spark, d):
    return C.chat_lines(C.no_tool_calls(W.chat(spark, d)), NOW)


# ---------------------------------------------------------------- session state


def _state(spark, d):
    e = W.load(spark, d, "events")
    return e.select((F.col("user_id") % 50).cast("string").alias("session"), F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("memory_type"), (F.col("event_id") % 10).cast("int").alias("priority"), F.col("event_id").cast("double").alias("added_at"), (F.col("event_id") % 4).cast("string").alias("user_id"))


_ST = "st as (select cast(user_id % 50 as varchar) as session, cast(event_id as varchar) as id, event_type as memory_type, (event_id % 10)::int as priority, event_id::double as added_at, cast(event_id % 4 as varchar) as user_id from events)"


@register(f"with {_ST} select session, id, memory_type from (select *, row_number() over (partition by session, memory_type order by priority desc, added_at desc, id desc) as rn from st) where rn <= case memory_type when 'click' then 3 when 'view' then 2 else 5 end")
def capacity_evict(spark, d):
    return R.capacity_evict(_state(spark, d), {"click": 3, "view": 2}, 5).select("session", "id", "memory_type")


@register(f"with {_ST}, u as (select session, count(distinct user_id) as n from st group by 1) select session, id, user_id from (select st.*, n, row_number() over (partition by session, user_id order by priority desc, added_at desc, id desc) as rn from st join u using (session)) where rn <= greatest(1, floor(14 / n))")
def shared_capacity(spark, d):
    return R.shared_capacity(_state(spark, d), 14).select("session", "id", "user_id")


@register(
    f"with {_ST}, o as (select * replace (case when event_id % 3 = 0 then '' else user_id end as user_id) from (select st.*, st.id::bigint as event_id from st)), n as (select session, count(distinct user_id) as n from o where memory_type = 'click' and user_id <> '' group by 1), "
    "r as (select o.*, n, row_number() over (partition by session, memory_type, user_id = '' order by priority desc, added_at desc, id desc) as own, row_number() over (partition by session, memory_type, user_id order by priority desc, added_at, id) as mine from o left join n using (session)) "
    "select session, id, memory_type, user_id from r where case when memory_type <> 'click' then true when user_id = '' then own <= 4 else mine <= 10 // n end"
)
def knowledge_capacity(spark, d):
    """One type split into references about no user and about users, who share a capacity."""
    s = _state(spark, d).withColumn("user_id", F.when(F.col("id").cast("long") % 3 == 0, "").otherwise(F.col("user_id")))
    return R.knowledge_capacity(s, R.Knowledge("click", 4, 10)).select("session", "id", "memory_type", "user_id")


_SPEAKERS = "case when sender_id <> '' then lpad(cast(cast(sender_id as int) - 99999 as {}), 9, '0') else '' end"


@register(
    f"{sql('prof', 'chat')}, {_PV}, r as (select *, row_number() over (partition by user_id order by is_active desc, updated_at desc, id) as rn from pv where memory_scope in ('a', 'public')), "
    f"u as (select session, s as user_id, coalesce(arg_max(sender_name, seq) filter (trim(coalesce(sender_name, '')) <> ''), '') as latest_name from (select *, {_SPEAKERS.format('varchar')} as s from chat) where role = 'user' and s <> '' group by 1, 2) "
    "select session, user_id, latest_name, id, attribute from u join r using (user_id) where rn <= 5"
)
def session_profiles(spark, d):
    """The profiles of the users who speak in every session."""
    turns = W.chat(spark, d).withColumn("sender_id", F.expr(_SPEAKERS.format("string")))
    return browse.session_profiles(turns, W.profile_memories(spark, d), "a", 5).select("session", "user_id", "latest_name", "id", "attribute")


@register(f"{sql('prof')}, {_PV} select id, attribute, is_active from pv where user_id = '000000010'")
def profile_detail(spark, d):
    return browse.profile_detail(W.profile_memories(spark, d), "000000010").select("id", "attribute", "is_active")


@register(f"with {_ST}, c as (select *, case memory_type when 'click' then 300 else 500 end as capacity from st) select memory_type, count(*) as current, capacity, round(count(*) / capacity, 4) as usage, count(*) filter (priority >= 5) as high, count(*) filter (priority < 5) as low from c group by memory_type, capacity")
def session_stats(spark, d):
    return browse.session_stats(_state(spark, d), {"click": 300}, 500)


@register(f"with {_ST}, h as (select * from st where added_at % 3 = 0), b as (select *, added_at as pos from st where added_at % 5 = 1), bn as (select * from b where (session, id) not in (select (session, id) from h)), u as (select session, count(distinct user_id) as n from (select session, user_id from h union all select session, user_id from b) group by 1), c as (select session, user_id, count(*) as have from h group by 1, 2) select session, id from (select bn.*, n, coalesce(have, 0) as have, row_number() over (partition by session, user_id order by pos) as rn from bn join u using (session) left join c using (session, user_id)) where rn <= greatest(1, floor(200 / n)) - have")
def session_admission(spark, d):
    s = _state(spark, d)
    return R.admit(s.filter("added_at % 3 = 0"), s.filter("added_at % 5 = 1").withColumn("pos", F.col("added_at")), 200).select("session", "id")


@register(f"{sql('mem')}, r as (select id, memory_type, row_number() over (order by strength desc, id) as rank from mem order by strength desc, id limit 50) select memory_type, row_number() over (order by min(rank)) as place, string_agg(id, ',' order by rank) as ids from r group by 1")
def group_by_type(spark, d):
    w = Window.orderBy(F.desc("strength"), "id")
    r = W.memories(spark, d).orderBy(F.desc("strength"), "id").limit(50).select("id", "memory_type", F.row_number().over(w).alias("rank"))
    return browse.by_type(r)


@register(f"{sql('mem')}, k as (select *, lower(trim(regexp_replace(judgment, '\\s+', ' ', 'g'))) as key from mem) select id from (select id, row_number() over (partition by key order by created_at, id) as rn from k) where rn = 1")
def judgment_dedupe(spark, d):
    m = W.memories(spark, d).withColumn("key", text.dedupe_key(F.col("judgment")))
    return R.first_wins(m, ["key"], [F.col("created_at"), F.col("id")]).select("id")


# ---------------------------------------------------------------- functions without SQL twins, soul state, simulator


@register("select doc_id, ceil(round(0.3 * length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) + 0.6 * (length(text) - length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'))), 6))::int as tokens from documents")
def token_estimate(spark, d):
    return W.load(spark, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


_FITS = "len(list_filter(range(1, length({t}) + 1), lambda i: 2 * i - length(regexp_replace({p}, '[^\\x00-\\x7F]', '', 'g')) <= 166))"


@register(
    "with t as (select doc_id, coalesce(text, '') as text, substr(coalesce(text, ''), 1, 166) as h, right(coalesce(text, ''), 166) as e from documents) "
    f"select doc_id, substr(text, 1, {_FITS.format(t='h', p='substr(h, 1, i::bigint)')}) as head, right(text, {_FITS.format(t='e', p='right(e, i::bigint)')}) as tail from t"
)
def token_truncate(spark, d):
    t = W.load(spark, d, "documents")
    return t.select("doc_id", jsonscan.truncate_tokens(F.col("text"), 50).alias("head"), jsonscan.truncate_tokens(F.col("text"), 50, True).alias("tail"))


@register("select event_id, props as found from events")
def json_extract(spark, d):
    e = W.load(spark, d, "events")
    said = F.concat(F.lit('so {"a": 1} ---JSON--- ```json {"feedback_data": '), F.col("props"), F.lit("} ```"))
    return e.select("event_id", jsonscan.extract_json(said, feedback=True).alias("found"))


def _steps(spark, d):
    e = W.load(spark, d, "events")
    code = F.lpad(F.bin(F.col("event_id") % 16), 4, "0")
    return e.select((F.col("user_id") % 20).cast("string").alias("key"), F.col("event_id").cast("double").alias("ts"), F.lit(0).alias("seq"), code.alias("code"), F.when(F.expr("event_id % 3 = 0"), "reflect").otherwise("resonate").alias("mode"))


_ENERGY = ", ".join(
    f"greatest(-20, least(20, e{i} + (case when substr(code, {i + 1}, 1) = '1' then 1 else -1 end) * s * exp(-0.1 * abs(e{i} - {mid})) + ({mid} - e{i}) * 0.1)) as e{i}"
    for i, (_, mid, _) in enumerate(scoring.SOUL.values())
)


@register(
    "with recursive log as (select cast(user_id % 20 as varchar) as key, bin(event_id % 16 + 16)[2:] as code, case when event_id % 3 = 0 then 1.0 else 0.3 end::double as s, row_number() over (partition by user_id % 20 order by event_id) as n from events), "
    "run as (select key, 0::bigint as n, 0::double as e0, 0::double as e1, 0::double as e2, 0::double as e3 from (select distinct key from log) "
    f"union all select log.key, log.n, {_ENERGY} from run join log on log.key = run.key and log.n = run.n + 1) "
    "select key, round(e0, 6) as recall, round(e1, 6) as impression, round(e2, 6) as expression, round(e3, 6) as creativity from run where (key, n) in (select (key, max(n)) from log group by key)"
)
def soul_fold(spark, d):
    return stateful.fold_soul(_steps(spark, d)).select("key", r6("recall"), r6("impression"), r6("expression"), r6("creativity"))


@register("select x, round(greatest(-20, least(20, x + exp(-0.1 * abs(x - 7.0)) + (7.0 - x) * 0.1)), 6) as up, greatest(1, least(20, round_even(7 + case when x >= 0 then 13 else 6 end * tanh(0.3 * x), 0)))::double as value, round(greatest(0, least(1, (x - 1.0) / 19.0)), 6) as share from (select distinct round(c_acctbal / 500, 1) as x from customer)")
def soul_mapping(spark, d):
    x = W.load(spark, d, "customer").select(F.round(F.col("c_acctbal") / 500, 1).alias("x")).distinct()
    up = scoring.elastic_step(F.col("x"), F.lit(1), 7.0, F.lit(1.0))
    return x.select("x", F.round(up, 6).alias("up"), scoring.soul_value(F.col("x"), "RecallDepth").alias("value"), F.round(scoring.soul_share(F.col("x"), "RecallDepth"), 6).alias("share"))


@register("with g as (select l_suppkey as k, list_sort(list(l_quantity::double)) as v, count(*) as n from lineitem group by 1), j as (select *, greatest(1, least(floor(0.9 * (n + 1))::int, n - 1)) as j from g where n >= 2) select k, round(v[j] + (v[j + 1] - v[j]) * (0.9 * (n + 1) - j), 6) as p90 from j")
def p90_exclusive(spark, d):
    g = W.load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.collect_list(F.col("l_quantity").cast("double")).alias("v")).filter("size(v) >= 2")
    return g.select("k", F.round(S.p90_column(F.col("v")), 6).alias("p90"))


@register()
def decay_simulation(spark, d):
    return S.grid_average(S.simulate(S.grid(spark, [4, 8], [1, 2], 2, calls_per_day=20, days=60)))


@register("select conv_id, turn, case when '{now}'::double - ts < 60 then '刚刚' when '{now}'::double - ts < 3600 then floor(('{now}'::double - ts) / 60)::bigint || '分钟前' when '{now}'::double - ts < 86400 then floor(('{now}'::double - ts) / 3600)::bigint || '小时前' else floor(('{now}'::double - ts) / 86400)::bigint || '天前' end as age from (select conv_id, turn, 1710000000.0 - conv_id * 997 - turn * 7 as ts from conversations)".replace("{now}", str(NOW)))
def relative_time(spark, d):
    c = W.load(spark, d, "conversations").select("conv_id", "turn", (F.lit(1710000000.0) - F.col("conv_id") * 997 - F.col("turn") * 7).alias("ts"))
    return c.select("conv_id", "turn", text.chat_age(F.lit(NOW), F.col("ts")).alias("age"))


# ---------------------------------------------------------------- mutations as snapshots

_PARITY = "case when substr(id, 2)::bigint % 2 = 0 then id else 'z' || id end"


@register(f"{sql('mem')}, n as (select {_PARITY} as id, 'new ' || id as judgment, 1 as strength from mem where substr(id, 2)::bigint % 10 < 2) select id, judgment, strength from mem where id not in (select id from n) union all select id, judgment, strength from n")
def upsert_by_id(spark, d):
    m = W.memories(spark, d).select("id", "judgment", "strength")
    n = F.substring(F.col("id"), 2, 20).cast("long")
    new = m.filter(n % 10 < 2).select(F.when(n % 2 == 0, F.col("id")).otherwise(F.concat(F.lit("z"), "id")).alias("id"), F.concat(F.lit("new "), "id").alias("judgment"), F.lit(1).alias("strength"))
    return store.upsert_by_id(m, new)


@register(f"{sql('mem')} select 'k' || id as id, memory_type, trim(judgment) as judgment, 10 as strength, false as is_active, 'public' as memory_scope from mem where strength = 3 union all select id, memory_type, judgment, strength, is_active, memory_scope from mem")
def remember_defaults(spark, d):
    m = W.memories(spark, d).drop("tags")
    new = m.filter("strength = 3").select(F.concat(F.lit("k"), "id").alias("id"), "memory_type", "judgment")
    return store.insert(m, new).select("id", "memory_type", "judgment", "strength", "is_active", "memory_scope")


@register(f"{sql('mem', 'dim', 'rel')} select (select count(*) from mem where strength <> 4) as records, (select count(*) from rel where memory_id not in (select id from mem where strength = 4)) as links")
def delete_memories(spark, d):
    m, _, rel = _tags(spark, d)
    records, links = store.delete(m, rel, m.filter("strength = 4").select("id"))
    return records.agg(F.count("*").alias("records")).crossJoin(links.agg(F.count("*").alias("links")))


@register(f"{sql('mem')}, names as (select distinct unnest(tags) as name from mem), old as (select name, row_number() over (order by name) as id from names where name not like 'src1%'), fresh as (select name, (select max(id) from old) + row_number() over (order by name) as id from names where name like 'src1%') select id, name from old union all select id, name from fresh")
def tag_bind_new(spark, d):
    m = W.memories(spark, d)
    all_names = store.tag_dimension(m).select("name").filter("name not like 'src1%'")
    dim = store.number(all_names, [F.col("name")], "id", 1)
    return store.bind_tags(dim, spark.createDataFrame([], "memory_id string, tag_id long"), m)[0]


@register(f"{sql('mem', 'dim', 'rel')} select memory_id, name from rel join dim on dim.id = rel.tag_id where memory_id not in (select id from mem where strength = 2) union all select id, 'replaced' from mem where strength = 2")
def tag_replace(spark, d):
    m, dim, rel = _tags(spark, d)
    new = m.filter("strength = 2").select("id", F.array(F.lit("replaced"), F.lit(" ")).alias("tags"))
    grown, links = store.replace_tags(dim, rel, new)
    return links.join(grown.withColumnRenamed("id", "tag_id"), "tag_id").select("memory_id", "name")


@register(f"{sql('mem', 'dim')}, asked as (select row_number() over (order by event_type desc) as pos, event_type as name from (select distinct event_type from events)) select pos, name, coalesce(dim.id, (select max(id) from dim) + (select count(*) from asked x where x.name <= asked.name and x.name not in (select name from dim))) as id from asked left join dim using (name)")
def names_to_ids(spark, d):
    dim = store.tag_dimension(W.memories(spark, d))
    asked = W.load(spark, d, "events").select(F.col("event_type").alias("name")).distinct()
    return store.names_to_ids(dim, asked.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("name")))))


@register(f"{sql('mem', 'dim')} select n as pos, dim.id, name from (select unnest([5, 3, 999, 1]) as id, unnest([0, 1, 2, 3]) as n) a join dim using (id)")
def ids_to_names(spark, d):
    dim = store.tag_dimension(W.memories(spark, d))
    return store.ids_to_names(dim, spark.createDataFrame([(0, 5), (1, 3), (2, 999), (3, 1)], "pos int, id long"))


_REG = "reg as (select 's' || page_id as source_id, page_id as note_short_id, 'p' || page_id || '.md' as source_file_path from pages)"


@register(
    f"with {_REG}, new as (select case when page_id % 2 = 1 then 'n' else 's' end || page_id as source_id, case when page_id % 3 = 0 then 'moved' || page_id || '.md' else 'p' || page_id || '.md' end as p from pages), "
    "k as (select new.*, coalesce(a.note_short_id, b.note_short_id) as sid from new left join reg a using (source_id) left join reg b on b.source_file_path = new.p), "
    "f as (select source_id, p, coalesce(sid, (select max(note_short_id) from reg) + row_number() over (partition by sid is null order by p)) as sid from k) "
    "select source_id, sid as note_short_id, p as source_file_path from f union all select * from reg where source_id not in (select source_id from f) and source_file_path not in (select p from f) and note_short_id not in (select sid from f)"
)
def register_notes(spark, d):
    p = W.load(spark, d, "pages").select("page_id")
    name = F.concat(F.lit("p"), "page_id", F.lit(".md"))
    extra = [F.lit("h").alias("heading"), F.lit(1).alias("total_lines"), F.lit(0.0).alias("updated_at")]
    reg = p.select(F.concat(F.lit("s"), "page_id").alias("source_id"), F.col("page_id").alias("note_short_id"), name.alias("source_file_path"), *extra)
    moved = F.when(F.expr("page_id % 3 = 0"), F.concat(F.lit("moved"), "page_id", F.lit(".md"))).otherwise(name)
    new = p.select(F.expr("case when page_id % 2 = 1 then 'n' else 's' end || page_id").alias("source_id"), moved.alias("source_file_path"), *extra)
    return store.register_notes(reg, new).select("source_id", "note_short_id", "source_file_path")


@register(f"{sql('note')}, reg as (select file_id, row_number() over (order by file_id) as s from note where length(content) % 2 = 0) select note.file_id, coalesce(s, -1) as note_short_id from note left join reg using (file_id)")
def short_id_enrichment(spark, d):
    n = W.notes(spark, d).select("file_id", "source_file_path", "content")
    even = n.filter("char_length(content) % 2 = 0")
    reg = even.select(F.col("file_id").alias("source_id"), F.row_number().over(Window.orderBy("file_id")).alias("note_short_id"), "source_file_path")
    return store.with_short_ids(n, reg).select("file_id", "note_short_id")


@register("select term, count(*) as df from (select unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '') || ' changed ' || coalesce(source, '')), '[a-z0-9_]+'))) as term from documents) group by 1 having count(*) >= 10")
def index_update(spark, d):
    """Every document changes, and a copy of every document is deleted."""
    docs = W.load(spark, d, "documents").select("doc_id", "text", "source")
    copies = docs.withColumn("doc_id", -1 - F.col("doc_id"))
    index = V.postings(docs.union(copies), "doc_id", ["text"])
    changed = docs.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" changed "), F.coalesce("source", F.lit(""))))
    new = V.update_postings(index, changed, copies, "doc_id", ["text"])
    return new.groupBy("term").agg(F.count("*").alias("df")).filter("df >= 10")


def _letters(t):
    """An embedder that SQL can state: the length and the numbers of two letters."""
    return F.array(F.char_length(t), *[F.char_length(t) - F.char_length(F.replace(t, F.lit(c), F.lit(""))) for c in "ea"]).cast("array<float>")


_LETTERS = "[length({t})::float, (length({t}) - length(replace({t}, 'e', '')))::float, (length({t}) - length(replace({t}, 'a', '')))::float]"


@register(
    "with d as (select doc_id, coalesce(text, '') as t, case when doc_id % 2 = 0 then 'm' else 'z' end || doc_id as new_id from documents), u as (select 'm' || doc_id as id, t || ' old' as t from d where 'm' || doc_id not in (select new_id from d) union all select new_id, t from d) "
    f"select id as item_id, t as vector_text, {_LETTERS.format(t='t')} as embedding from u"
)
def vector_upsert(spark, d):
    """An index of all documents takes in all documents again, some under their id, each twice; the first row of an id wins."""
    doc = W.load(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    index = doc.select(F.concat(F.lit("m"), "doc_id").alias("item_id"), F.concat("t", F.lit(" old")).alias("vector_text")).withColumn("embedding", _letters(F.col("vector_text")))
    rows = doc.select(F.expr("case when doc_id % 2 = 0 then 'm' else 'z' end || doc_id").alias("item_id"), F.col("t").alias("vector_text"), F.lit(0).alias("pos"))
    return V.vector_upsert(index, rows.union(rows.withColumn("vector_text", F.lit("late")).withColumn("pos", F.lit(1))), _letters)


@register("select vec_id, label from embeddings order by label, vec_id limit 30 offset 60")
def vector_page(spark, d):
    return R.page(W.load(spark, d, "embeddings").select("vec_id", "label"), [F.col("label"), F.col("vec_id")], 3, 30)


@register("select vec_id, round(1.0 - (row_number() over (order by s desc, vec_id) - 1) / (count(*) over () - 1), 6) as share from (select vec_id, (vec_id * 7919) % 101 as s from embeddings)")
def rank_normalize(spark, d):
    e = W.load(spark, d, "embeddings").select("vec_id", ((F.col("vec_id") * 7919) % 101).alias("s"))
    return e.select("vec_id", F.round(V.rank_normalize(e, [F.desc("s"), F.col("vec_id")]), 6).alias("share"))


@register(f"{sql('mem')} select id, 'm' || (row_number() over (order by strength desc, id) - 1) as short_id from mem order by strength desc, id limit 40")
def ephemeral_ids(spark, d):
    order = [F.desc("strength"), F.col("id")]
    return store.ephemeral_ids(W.memories(spark, d).orderBy(*order).limit(40), order).select("id", "short_id")


@register(f"{sql('mem')}, c as (select id, case when strength % 3 = 0 then '' else judgment end as j, judgment || reasoning as doc from mem) select id, trim(case when trim(j) <> '' then j else doc end) as judgment, case when trim(j) <> '' and trim(doc) <> trim(j) then trim(doc) else '' end as reasoning from c")
def collection_import(spark, d):
    m = W.memories(spark, d)
    c = m.select("id", F.when(F.expr("strength % 3 = 0"), "").otherwise(F.col("judgment")).alias("judgment"), F.concat("judgment", "reasoning").alias("document"), F.lit("").alias("reasoning"), "created_at")
    return store.from_collection(c).select("id", "judgment", "reasoning")


@register(f"{sql('mem')} select id, [trim(x) for x in string_split(t, ',') if trim(x) <> ''] as tags from (select id, array_to_string(tags, ' , ') as t from mem)")
def parse_tags(spark, d):
    m = W.memories(spark, d).select("id", F.array_join("tags", " , ").alias("t"))
    return m.select("id", T.parse_tags(F.col("t")).alias("tags"))


@register(f"{sql('mem')} select id, case when length(judgment) > 40 then substr(judgment, 1, 40) || '...' else judgment end as snippet, replace(substr(reasoning, 1, 80), chr(10), ' ') as preview, regexp_replace(judgment, '\\n+', chr(10), 'g') as squeezed, trim(regexp_replace(judgment, '\\s+', ' ', 'g')) as line from mem")
def text_shapes(spark, d):
    j = F.col("judgment")
    return W.memories(spark, d).select("id", text.snippet(j, 40).alias("snippet"), text.preview(F.col("reasoning")).alias("preview"), text.squeeze_newlines(j).alias("squeezed"), text.collapse_space(j).alias("line"))


@register(f"{sql('mem')} select id, judgment || ', ' || array_to_string(tags, ', ') as core from mem")
def semantic_core(spark, d):
    return W.memories(spark, d).select("id", text.semantic_core(F.col("judgment"), F.col("tags")).alias("core"))


@register(f"{sql('mem')} select id from mem where list_aggregate([contains(lower(judgment), p) for p in ['the', 'avec', 'und']], 'bool_or')")
def precise_filter(spark, d):
    return W.memories(spark, d).filter(text.contains_any_part(F.col("judgment"), F.lit("the|AVEC und"))).select("id")


@register("select event_id, case when value % 2 < 1 then value else 0.0 end as t from (select event_id, event_id / 4.0 as value from events)")
def coerce_timestamps(spark, d):
    e = W.load(spark, d, "events").select("event_id", (F.col("event_id") / F.lit(4.0)).alias("value"))
    raw = F.when(F.col("value") % 2 < 1, F.col("value").cast("string")).otherwise("not a time")
    return e.select("event_id", text.coerce_timestamp(raw, F.lit(0.0)).alias("t"))


@register("select user_id % 30 as k, avg(value) as a, case when avg(value) > 50 then '1' else '0' end || case when avg(value) > 1e9 then '1' else '0' end || case when avg(value) > -1 then '1' else '0' end || case when avg(value) > 50 then '1' else '0' end as code from events group by 1".replace("avg(value) as a, ", ""))
def resonance_codes(spark, d):
    a = W.load(spark, d, "events").groupBy((F.col("user_id") % 30).alias("k")).agg(F.avg("value").alias("a"))
    cur = dict(zip(scoring.SOUL, (F.lit(50.0), F.lit(1e9), F.lit(-1.0), F.lit(50.0)), strict=True))
    return a.select("k", scoring.resonance_code(dict.fromkeys(scoring.SOUL, F.col("a")), cur).alias("code"))


@register("with r as (select vec_id as rank, 'f' || label as source_file_path, 'v' || vec_id as id from embeddings) select source_file_path, row_number() over (order by min(rank)) as place, string_agg(id, ',' order by rank) as chunk_ids from r group by 1")
def group_by_file(spark, d):
    e = W.load(spark, d, "embeddings")
    return N.by_file(e.select(F.col("vec_id").alias("rank"), F.concat(F.lit("f"), "label").alias("source_file_path"), F.concat(F.lit("v"), "vec_id").alias("id")))


@register(f"{sql('mem')}, {_USEFUL}, {_RECALLED} select id from recalled where id not in (select id from useful)")
def wasted_recalls(spark, d):
    return _ids(spark, d, "click").join(_ids(spark, d, "purchase"), "id", "left_anti")


def _actions(spark, d):
    e = W.load(spark, d, "events")
    mem = F.struct(F.lit("knowledge").alias("type"), F.concat(F.lit("merged "), "event_id").alias("judgment"), F.lit("").alias("reasoning"), F.array(F.lit("t")).alias("tags"))
    return e.select(F.col("event_id").alias("action_no"), F.when(F.expr("event_id % 3 = 0"), "merge").when(F.expr("event_id % 3 = 1"), "updata").otherwise("create").alias("action"), F.when(F.expr("event_id % 3 = 0"), F.array(F.concat(F.lit("m"), F.col("event_id")), F.concat(F.lit("m"), F.col("event_id") + 1))).otherwise(F.array(F.concat(F.lit("m"), F.col("event_id")))).alias("source_memory_ids"), mem.alias("memory"))


@register(
    f"{sql('mem')}, act as (select event_id, case event_id % 3 when 0 then 'merge' when 1 then 'updata' else 'create' end as action from events), "
    "named as (select event_id, 0 as pos, 'm' || event_id as id from act where action <> 'create' union all select event_id, 1, 'm' || (event_id + 1) from act where action = 'merge'), "
    "own as (select * from (select *, row_number() over (partition by id order by event_id, pos) as rn from named) where rn = 1), used as (select own.event_id, mem.* from own join mem using (id)), "
    "sums as (select event_id, sum(strength)::int as s, max(useful_score) as us from used group by 1) "
    "select 'merged ' || act.event_id as judgment, coalesce(s, 10)::int as strength, coalesce(us, 0.0) as useful_score from act left join sums using (event_id) where action = 'create' or s is not null "
    "union all select judgment, strength, useful_score from mem where id not in (select id from used)"
)
def memory_actions(spark, d):
    """Merges and updates over whole tables: each event is an action on two memories."""
    m = W.memories(spark, d).drop("tags").withColumn("memory_scope", F.lit("public"))
    return L.apply_actions(m, L.normalize_actions(_actions(spark, d)), NOW).select("judgment", "strength", "useful_score")


# ---------------------------------------------------------------- scans, lookups and upkeep


@register(f"{sql('mem')} select id, created_at from mem")
def newest_first(spark, d):
    return store.newest_first(W.memories(spark, d)).select("id", "created_at")


@register(f"{sql('mem')} select id from mem")
def memory_ids(spark, d):
    return store.memory_ids(W.memories(spark, d))


def _registry(spark, d):
    p = W.load(spark, d, "pages")
    return p.select(F.concat(F.lit("s"), "page_id").alias("source_id"), F.col("page_id").alias("note_short_id"), F.concat(F.lit("p"), F.floor(F.col("page_id") / 2), F.lit(".md")).alias("source_file_path"))


@register("select 's' || page_id as source_id, page_id as note_short_id from pages where page_id = 17")
def note_by_short_id(spark, d):
    return store.note_by_short_id(_registry(spark, d), 17).select("source_id", "note_short_id")


@register("select 'p' || (page_id // 2) || '.md' as source_file_path, min(page_id) as note_short_id from pages group by 1")
def short_ids_of_paths(spark, d):
    reg = _registry(spark, d)
    return store.short_ids_of_paths(reg, reg.select("source_file_path"))


@register(f"{sql('idx', 'disk')}, i as (select row_number() over (order by relative_path) as id, relative_path from idx), f as (select relative_path, row_number() over (order by relative_path) as n from (select distinct relative_path from disk) where relative_path not in (select relative_path from idx)) select * from i union all select (select max(id) from i) + n, relative_path from f")
def allocate_file_ids(spark, d):
    index = store.number(W.file_index(spark, d).select("relative_path"), [F.col("relative_path")], "id", 1)
    return store.allocate_file_ids(index, W.disk_files(spark, d))


@register(f"{sql('idx', 'disk')} select relative_path, file_timestamp from idx where relative_path not in (select relative_path from disk)")
def delete_files(spark, d):
    return N.delete_files(W.file_index(spark, d), W.disk_files(spark, d))


@register(f"{sql('mem')} select id from (select *, row_number() over (partition by judgment order by created_at desc, updated_at desc, id) as rn from mem) where rn = 1")
def newest_of_judgment(spark, d):
    return L.newest_of_judgment(W.memories(spark, d)).select("id")


@register("select distinct 'm' || (user_id % 1000) as id from events where event_type = 'click' and exists (select 1 from documents where doc_id = user_id % 1000)")
def memories_by_ids(spark, d):
    return store.memories_by_ids(W.memories(spark, d), _ids(spark, d, "click")).select("id")


@register(f"{sql('mem', 'dim')} select distinct trim(name) as name from dim where trim(name) <> ''")
def all_tag_names(spark, d):
    return store.all_tag_names(store.tag_dimension(W.memories(spark, d)))


@register(f"{sql('mem')} select id, strength from mem")
def drop_deprecated(spark, d):
    return store.drop_deprecated(W.memories(spark, d).select("id", "strength", F.lit(1).alias("old")), ["old", "never"])


@register(f"{sql('mem')} select id, judgment, '' as reasoning, strength, memory_type, created_at from mem")
def decode_memory(spark, d):
    m = W.memories(spark, d)
    old = F.struct("id", F.col("judgment").alias("content"), "strength", "memory_type", "created_at")
    new = F.struct("id", "judgment", "strength", "memory_type", "created_at")
    rows = m.select(F.when(F.expr("strength % 2 = 0"), F.to_json(old)).otherwise(F.to_json(new)).alias("value"))
    return store.decode_memory(spark, rows).select("id", "judgment", "reasoning", "strength", "memory_type", "created_at")


@register(_STRAT + f", {staged_sql(400)}, g as (select id, bm25_normalized_score as final_score from staged order by rank limit 400) select id, round(final_score, 6) as final_score from g where final_score >= 0.5 order by g.final_score desc, id limit 20")
def simple_recall(spark, d):
    return V.simple_recall(W.memories(spark, d), "the", ["and", "src1"], 20, "a").select("id", r6("final_score"))


@register(f"{sql('note')}, n as (select file_id, 0 as chunk_index, 'new ' || file_id as content from note where length(content) % 2 = 0) select file_id, chunk_index, content from n union all select file_id, 0, content from note where file_id not in (select file_id from n)")
def replace_file_chunks(spark, d):
    old = W.notes(spark, d).select("file_id", F.lit(0).alias("chunk_index"), "content")
    new = old.filter("char_length(content) % 2 = 0").withColumn("content", F.concat(F.lit("new "), "file_id"))
    return N.replace_file_chunks(old, new)


@register(f"with {_SC} select id, content, source_file_path, chunk_index as a, chunk_index + 3 as b from sc")
def result_shape(spark, d):
    c = _stored_chunks(spark, d).withColumn("line_start", F.col("chunk_index")).withColumn("line_end", F.col("chunk_index") + 3)
    return N.result_shape(c).select("id", "content", "source_file_path", F.col("lines.line_start").alias("a"), F.col("lines.line_end").alias("b"))


@register("select file_id, chunk_index, max(line_end) as line_end from (select coalesce(source, 'none') as file_id, doc_id % 3 as chunk_index, doc_id as line_end from documents) group by 1, 2")
def newest_chunks(spark, d):
    c = W.load(spark, d, "documents").select(F.coalesce("source", F.lit("none")).alias("file_id"), (F.col("doc_id") % 3).alias("chunk_index"), F.col("doc_id").alias("line_end"))
    return N.newest_chunks(c)


@register(f"{sql('mem')}, {_ST} select session, st.id, judgment from st join mem on mem.id = 'm' || st.id")
def session_hydrate(spark, d):
    """Session references with their memories; those to memories that are gone fall away."""
    cache = _state(spark, d).withColumn("id", F.concat(F.lit("m"), "id")).select("session", "id")
    return stateful.hydrate(cache, W.memories(spark, d).select("id", "judgment")).select("session", F.expr("substr(id, 2)").alias("id"), "judgment")


@register("select part, regexp_replace(trim(name), '[^A-Za-z0-9_.-]+', '_', 'g') as clean, trim(name) || ' ' || part || ' key' as rag from (select p_partkey as part, ' ' || p_name || ' / v1 ' as name from part)")
def names_and_rag(spark, d):
    p = W.load(spark, d, "part").select(F.col("p_partkey").alias("part"), F.concat(F.lit(" "), "p_name", F.lit(" / v1 ")).alias("name"))
    rag = text.rag_query(F.array(F.trim("name")), F.array(F.col("part").cast("string"), F.lit("capped")), F.array(F.lit("key"), F.lit("capped")), 1)
    return p.select("part", text.clean_model_name(F.col("name")).alias("clean"), rag.alias("rag"))


@register(
    ORACLES["memory_actions"].split("select 'merged '")[0]
    + f", now as (select 'merged ' || act.event_id as vector_text from act left join sums using (event_id) where action = 'create' or s is not null union all select judgment from mem where id not in (select id from used) and judgment <> '') select vector_text, {_LETTERS.format(t='vector_text')} as embedding from now"
)
def feedback_index(spark, d):
    """The vector index after the actions: rows of merged memories are gone, new texts embedded."""
    m = W.memories(spark, d).drop("tags").withColumn("memory_scope", F.lit("public"))
    index = m.select(F.col("id").alias("item_id"), F.col("judgment").alias("vector_text")).filter("vector_text != ''")
    index = index.withColumn("embedding", _letters(F.col("vector_text")))
    after = L.apply_actions(m, L.normalize_actions(_actions(spark, d)), NOW)
    return V.follow_records(index, after.withColumn("vector_text", F.col("judgment")), _letters).select("vector_text", "embedding")


@register("select n, base, (case when n <= 1 then greatest(base, 800) when n <= 3 then greatest(base, 240) else base end)::int as hits from (select distinct (l_linenumber - 1)::int as n, (l_quantity * 10)::int as base from lineitem)")
def hit_limits(spark, d):
    x = W.load(spark, d, "lineitem").select((F.col("l_linenumber") - 1).cast("int").alias("n"), (F.col("l_quantity") * 10).cast("int").alias("base")).distinct()
    return x.select("n", "base", text.hit_limit(F.col("n"), F.col("base")).alias("hits"))


# ---------------------------------------------------------------- scans, lookups and recall modes


@register(
    f"{sql('mem')}, {_MT}, {bm25_sql('mt', 'id', _FIELDS, QUERY)}, {staged_sql(600)}, g as (select id, bm25_normalized_score as final_score from staged order by rank limit 600) "
    "select id, round(g.final_score, 6) as final_score from g join mem using (id) where g.final_score >= 0.5 and memory_scope in ('a', 'public') order by g.final_score desc, id limit 30"
)
def recall_post_scope(spark, d):
    """Recall whose scope is filtered after ranking: statistics and candidates are those of all memories."""
    return V.recall(W.memories(spark, d), QUERY, 30, "a", scope_mode="post").select("id", r6("final_score"))


@register(
    f"{sql('mem')}, {_VQ}, v as (select * from (select 'm' || vec_id as id, {_COS} as score from embeddings, q order by score desc, id limit 40) where score >= 0.5 order by score desc, id limit 30), "
    f"c as (select id, score, case when is_active then score else score / (1 + 0.05 * greatest(({NOW} - created_at) / 86400.0, 0)) end as sim from v join mem using (id) where memory_scope in ('a', 'public')) "
    "select id, round(sim, 6) as similarity from c order by sim desc, score desc, id limit 10"
)
def recall_vector_fallback(spark, d):
    """A query that no text holds: the vectors alone answer."""
    v = V.vector_top_k(W.vectors(spark, d), "id", "embedding", _query_vector(spark, d), 40)
    return V.comprehensive_recall(W.memories(spark, d), "qqqzzzxxx", 10, "a", NOW, vectors=v).select("id", r6("similarity"))


@register(f"{sql('mem')} select id, case when created_at > 0 then case when s < 60 then '（刚刚）' when s < 3600 then '（' || floor(s / 60)::bigint || '分钟前）' when s < 86400 then '（' || floor(s / 3600)::bigint || '小时前）' when s < 2592000 then '（' || floor(s / 86400)::bigint || '天前）' else '（' || floor(s / 2592000)::bigint || '个月前）' end else '' end as age from (select *, {NOW} - created_at as s from mem)")
def memory_age(spark, d):
    return W.memories(spark, d).select("id", text.memory_age(F.col("created_at"), NOW).alias("age"))


@register(f"{sql('mem')}, a as (select item_id as pos, substr('m' || (item_id * 7 % 120), 1, 2 + item_id % 3) as short_id from benchmark) select pos, short_id, (select arg_min(id, struct_pack(a := created_at, b := id)) from mem where starts_with(mem.id, a.short_id)) as id from a where exists (select 1 from mem where starts_with(mem.id, a.short_id))")
def resolve_short_ids(spark, d):
    """Short ids back to whole ones: the oldest memory that begins with each."""
    asked = W.load(spark, d, "benchmark").selectExpr("item_id as pos", "substr('m' || cast(item_id * 7 % 120 as string), 1, cast(2 + item_id % 3 as int)) as short_id")
    return store.full_ids(asked, W.memories(spark, d), [F.col("created_at"), F.col("id")])


@register("with reg as (select 's' || page_id as source_id, page_id as note_short_id, 'p' || (page_id // 2) || '.md' as source_file_path from pages) select source_id, note_short_id from reg where source_file_path not in (select relative_path from (select case when page_id % 7 = 3 then 'live' else 'p' end || page_id || '.md' as relative_path from pages))")
def unregister_notes(spark, d):
    """The registry after the notes of all files on disk went."""
    left, _ = store.unregister_notes(_registry(spark, d), W.disk_files(spark, d).select(F.col("relative_path").alias("source_file_path")))
    return left.select("source_id", "note_short_id")


@register(f"{sql('idx')}, i as (select row_number() over (order by relative_path) as id, relative_path from idx) select id, relative_path from i where id = 12 union all select id, relative_path from i where relative_path = 'p20.md'")
def file_lookup(spark, d):
    """A file of the index by its id, and one by its path."""
    index = store.number(W.file_index(spark, d).select("relative_path"), [F.col("relative_path")], "id", 1)
    return N.file_by_id(index, 12).union(N.file_by_path(index, "p20.md")).select("id", "relative_path")


@register(f"{sql('note').replace('with ', 'with recursive ', 1)}, {_CHUNKED} select 'all' as scan, file_id, chunk_index, row_number() over (order by source_file_path, chunk_index) as place from chunk union all select 'path', file_id, chunk_index, chunk_index from chunk where source_file_path = (select max(source_file_path) from note)")
def chunk_scans(spark, d):
    """All chunks numbered in their order, and those of one note by its path."""
    chunks = _chunks(spark, d)
    last = W.notes(spark, d).agg(F.max("source_file_path")).first()[0]
    every = store.number(N.all_chunks(chunks).select("file_id", "source_file_path", "chunk_index"), [F.col("source_file_path"), F.col("chunk_index")], "place", 1)
    one = N.chunks_of_path(chunks, last)
    return every.select(F.lit("all").alias("scan"), "file_id", "chunk_index", "place").union(one.select(F.lit("path"), "file_id", "chunk_index", F.col("chunk_index").cast("long")))
