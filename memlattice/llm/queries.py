"""The registered queries of this folder and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlattice.llm.common import table


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memlattice.llm.near_dedup import near_dedup

    return near_dedup(table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memlattice.llm.embedding_dedup import embedding_dedup

    return embedding_dedup(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memlattice.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from memlattice.llm.bpe import bpe_round_trip

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memlattice.llm.language_id import held_out, identify_language

    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return identify_language(docs).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memlattice.llm.html_extract import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memlattice.llm.mixing import mix_plan

    return mix_plan(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memlattice.llm.class_lm import held_out, score_documents

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scored = score_documents(docs, ~held_out())
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memlattice.llm.repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text")).drop("kept")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memlattice.llm.pii import KINDS, find_pii, span_list

    found = find_pii(table(spark, sf_dir, "documents", "doc_id", "text"))
    bare = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    def count(kind: int):
        # a second parameter of the lambda, with a default or not, would be the place in the array
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return found.select(
        "doc_id", *counts, F.sha2(span_list(bare), 256).alias("base_sha256"), span_list(F.array_sort(F.concat(bare, "terms"))).alias("spans")
    )


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memlattice.llm.vector_search import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memlattice.llm.prefix_trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memlattice.llm.divergence import audit

    return audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_dedup": op1_minhash_dedup,
        "op2_embedding_dedup": op2_embedding_dedup,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_bpe": op4_bpe,
        "op5_language_id": op5_language_id,
        "op6_html": op6_html,
        "op7_mixing": op7_mixing,
        "op8_class_lm": op8_class_lm,
        "op9_repeats": op9_repeats,
        "op10_pii": op10_pii,
        "op11_nearest": op11_nearest,
        "op12_trie": op12_trie,
        "op13_divergence": op13_divergence,
    }


_OP3 = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as cp, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size,
       doc_id = first_value(doc_id) over w as kept, text_sha256
from d window w as (partition by text_sha256 order by cp desc, doc_id)
"""

_OP7 = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, md5(coalesce(doc_id::varchar, 't' || md5(coalesce(text, '')))) as k
  from documents),
s as (
  select source, sum(size)::bigint as source_size from d group by source),
w as (
  select *, [5.0, 2.0, 1.0][1 + (row_number() over (order by source nulls last) - 1) % 3]::double as weight, 3.0 * source_size as cap from s),
f as (
  select *, cap / weight as fill,
    (sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level
  from w),
t as (
  select source, source_size, least(cap, (select min_by(level, fill) from f where level <= fill) * weight)::double as target from f),
c as (
  select d.*, source_size, target, row_number() over () as rid, sum(size) over (partition by d.source order by k, doc_id, size rows unbounded preceding) as fin
  from d join t on d.source is not distinct from t.source),
e as (
  select rid, size, source, (epoch * source_size + fin) / target as vf from c, unnest([0, 1, 2]) as u(epoch) where size > 0),
r as (
  select rid, size, sum(size) over (order by vf, source nulls last rows unbounded preceding) - size / 2.0 <= (select sum(size) from d) as taken from e),
n as (
  select rid, sum(size)::bigint as taken from r where taken group by rid)
select doc_id, size, source_size, target, coalesce(n.taken, 0)::bigint as taken
from c left join n using (rid)
"""


#: CRC-32 of decimal digits, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv::varchar, ''), lambda x: ascii(x)::bigint)), lambda a, x:
      list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda b, y: xor(b >> 1, (b & 1) * 3988292384))))"""

_OP12 = rf"""
with own as (
  select conv_id as conv, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos,
         struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) as turn
  from conversations where conv_id is not null),
whole as (select conv, list(turn order by pos) as turns from own group by conv),
rebuilt as (
  select c.conv, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) as turns
  from (select *, conv - conv % 20 as base, ({_CRC} % 4)::int as h from whole) c left join whole b on b.conv = c.base),
p as (
  select conv, d as depth, turns[1:d] as path, len(turns) = d as ends from rebuilt, unnest(range(len(turns) + 1)) as u(d)),
n as (
  select path, depth, min(conv) as conv_id, count(*) as n_convs, string_agg(conv::varchar, ',' order by conv) filter (ends) as ids from p group by path, depth),
m as (
  select *, row_number() over () as id, coalesce(len(regexp_extract_all(path[depth].t, '[^\x20\x09-\x0D]+')), 0) as words from n),
k as (
  select m.*, u.id as up, u.conv_id as parent_conv_id, (select count(*) from m c where c.depth = m.depth + 1 and c.path[1:m.depth] = m.path) as n_children
  from m left join m u on u.depth = m.depth - 1 and u.path = m.path[1:m.depth - 1]),
s as (
  select a.id, sum((k.n_convs - 1) * k.words)::bigint as saved_tokens, count(*) filter (k.n_children = 0) as n_leaves
  from k, unnest(range(k.depth + 1)) as x(d) join m a on a.depth = x.d and a.path = k.path[1:x.d] group by a.id)
select k.conv_id, k.depth, k.parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(k.ids, '')) as ends_sha256
from k join s using (id)
"""

_OP13 = r"""
with d as (
  select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents),
w as (select rid, lang, source, unnest(terms) as term from d),
g as (select distinct lang, source from d),
v as (select lang, term from w group by all having count(distinct rid) >= 3),
c as (select lang, source, term, count(*)::hugeint as c from w semi join v using (lang, term) group by all),
n as (select g.lang, g.source, coalesce(sum(c), 0)::hugeint as n, (select count(*) from v where v.lang = g.lang)::hugeint as v from g left join c using (lang, source) group by all),
p as (
  select n.lang, n.source, v.term, coalesce(c.c, 0) as c, 1 + (1000000000 * (coalesce(c.c, 0) + 1)) // (n.n + n.v) as p
  from n join v using (lang) left join c on c.lang = n.lang and c.source = n.source and c.term = v.term),
l as (
  select lang, term, 1 + (1000000000 * (sum(c) + 1)) // any_value(n.n + n.v) as q
  from c join (select lang, sum(n) as n, any_value(v) as v from n group by lang) n using (lang) group by lang, term),
pairs as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p)::bigint as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
every as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source),
terms as (
  select p.lang, p.source, 'term' as part, p.term as item, ((p - q) * (p - q) // q)::bigint as value from p join l using (lang, term) where c > 0 and p > q)
select lang, source, part, item, value, (row_number() over (partition by lang, source, part order by value desc, encode(item)))::int as rank
from (select * from every union all select * from terms) qualify part = 'pair' or rank <= 200
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": _OP3, "op7_mixing": _OP7, "op12_trie": _OP12, "op13_divergence": _OP13}
