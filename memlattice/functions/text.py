"""Text normalisation, n-grams and small string functions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
#: Quotation marks that count as a double one.
_QUOTES = "“”‘’'"
_PART = "[一-鿿]+|[a-z0-9_]+"
_CJK = "^[一-鿿]"


def normalize_search_text(text: Column) -> Column:
    """Trimmed, lower-cased, full-width forms narrowed, quotes unified and taken off the ends; null is empty."""
    t = F.translate(F.lower(F.trim(F.coalesce(text, F.lit("")))), _WIDE + _QUOTES, _NARROW + '"' * len(_QUOTES))
    return F.trim(F.regexp_replace(F.trim(t), '^"+|"+$', ""))


def _parts(text: Column) -> Column:
    return F.regexp_extract_all(normalize_search_text(text), F.lit(f"({_PART})"), F.lit(1))


def _grams(part: Column, n: int) -> Column:
    last = F.char_length(part) - F.lit(n - 1)
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(part, i, F.lit(n))))


def index_tokens(text: Column) -> Column:
    """Distinct index terms in order of appearance: words of letters, digits and ``_`` whole, CJK runs as 1- and 2-grams."""
    each = F.transform(_parts(text), lambda p: F.when(p.rlike(_CJK), F.concat(_grams(p, 1), _grams(p, 2))).otherwise(F.array(p)))
    # without CJK there are no runs to cut, without full-width forms nothing to narrow, and quotes are in no term
    plain = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), F.lit(1))
    return F.array_distinct(F.when(text.isNull(), F.array().cast("array<string>")).when(text.rlike("[一-鿿！-～]"), F.flatten(each)).otherwise(plain))


def required_terms(text: Column) -> Column:
    """Terms a strict match must have: words whole, CJK runs of two or fewer whole, longer ones as 2-grams."""
    each = F.transform(_parts(text), lambda p: F.when(p.rlike(_CJK) & (F.char_length(p) > 2), _grams(p, 2)).otherwise(F.array(p)))
    return F.array_distinct(F.flatten(each))


def query_parts(query: Column) -> Column:
    """A query's search terms, cut at bars or white space."""
    return F.filter(F.split(F.trim(query), r"\s*\|\s*|\s+"), lambda t: t != "")


def contains_any_part(content: Column, query: Column) -> Column:
    """Whether the content holds one of the query's terms, case aside."""
    return F.exists(query_parts(F.lower(query)), lambda t: F.contains(F.lower(content), t))


def hit_limit(length: Column, base: Column) -> Column:
    """Candidates to fetch for a query of so many characters: short CJK queries match much."""
    return F.when(length <= 1, F.greatest(base, F.lit(800))).when(length <= 3, F.greatest(base, F.lit(240))).otherwise(base)


def like_pattern(keyword: str) -> str:
    """A LIKE pattern for the keyword anywhere, with its own wildcards escaped."""
    return "%" + keyword.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def squeeze_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\n+", "\n")


def remove_names(text: Column, names: list[str]) -> Column:
    """The text without the assistant's names (each entry may be several, barred), case aside."""
    for name in sorted({x.strip() for n in names for x in n.split("|") if x.strip()}, key=lambda x: (-len(x), x)):
        text = F.regexp_replace(text, "(?i)\\Q" + name.replace("\\E", "\\E\\\\E\\Q") + "\\E", "")
    return collapse_space(text)


def rag_query(entities: Column, facts: Column, keywords: Column, most: int | None = None) -> Column:
    """Entities, facts and keywords in one line; ``most`` caps facts and keywords."""
    cap = lambda c: F.slice(c, 1, most) if most else c
    parts = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in (entities, cap(facts), cap(keywords))])
    return F.array_join(F.filter(parts, lambda p: F.trim(p) != ""), " ")


def token_estimate(text: Column) -> Column:
    """0.3 a character of ASCII and 0.6 any other, rounded up."""
    ascii_ = F.char_length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x00-\x7F]", ""))
    other = F.char_length(F.coalesce(text, F.lit(""))) - ascii_
    return F.ceil(F.round(ascii_ * F.lit(0.3) + other * F.lit(0.6), 6)).cast("int")


def safe_title(title: Column) -> Column:
    t = F.regexp_replace(F.coalesce(title, F.lit("")), r'[\\/:*?"<>|\x00-\x1f]', "_")
    t = F.substring(F.regexp_replace(t, r"^[. ]+|[. ]+$", ""), 1, 80)
    return F.when(t == "", F.lit("untitled")).otherwise(t)


def note_file_name(title: Column, at: Column) -> Column:
    return F.concat(F.date_format(at, "yyyyMMdd_HHmmss"), F.lit("_"), safe_title(title), F.lit(".md"))


def note_body(title: Column, body: Column) -> Column:
    """The body, with the title as its first heading if it begins with none."""
    return F.when(F.startswith(F.ltrim(body), F.lit("#")), body).otherwise(F.concat(F.lit("# "), title, F.lit("\n\n"), body))


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.trim(F.replace(path, F.lit("\\"), F.lit("/"))), "^/+", "")


def first_heading(text: Column) -> Column:
    return F.trim(F.regexp_extract(text, r"(?m)^[ \t]*#[ \t]+(\S.*)$", 1))


def line_count(text: Column) -> Column:
    """Lines in the wide sense: all of Unicode's line boundaries count; a final one opens no line."""
    ends = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"
    lines = F.size(F.split(text, ends, -1))
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(lines - F.when(text.rlike(f"(?:{ends})\\z"), 1).otherwise(0))


def memory_age(now: Column, then: Column) -> Column:
    """Relative time as memories show it, with months."""
    d = now - then
    whole = lambda unit: F.floor(d / unit).cast("string")
    return (
        F.when(F.coalesce(then, F.lit(0.0)) <= 0, F.lit(""))
        .when(d < 60, F.lit("（刚刚）"))
        .when(d < 3600, F.concat(F.lit("（"), whole(60), F.lit("分钟前）")))
        .when(d < 86400, F.concat(F.lit("（"), whole(3600), F.lit("小时前）")))
        .when(d < 2592000, F.concat(F.lit("（"), whole(86400), F.lit("天前）")))
        .otherwise(F.concat(F.lit("（"), whole(2592000), F.lit("个月前）")))
    )


def chat_age(now: Column, then: Column) -> Column:
    """Relative time as chat lines show it."""
    d = now - then
    whole = lambda unit: F.floor(d / unit).cast("string")
    return (
        F.when(F.coalesce(then, F.lit(0.0)) == 0, F.lit(""))
        .when(d < 60, F.lit("刚刚"))
        .when(d < 3600, F.concat(whole(60), F.lit("分钟前")))
        .when(d < 86400, F.concat(whole(3600), F.lit("小时前")))
        .otherwise(F.concat(whole(86400), F.lit("天前")))
    )


def memory_line(short_id: Column, judgment: Column, reasoning: Column, now: Column, created_at: Column) -> Column:
    head = F.when(F.coalesce(short_id, F.lit("")) != "", F.concat(F.lit("["), short_id, F.lit("] "))).otherwise(F.lit(""))
    why = F.trim(F.coalesce(reasoning, F.lit("")))
    tail = F.when(why != "", F.concat(F.lit("\n——因为"), why)).otherwise(F.lit(""))
    return F.concat(head, F.trim(F.coalesce(judgment, F.lit(""))), tail, memory_age(now, created_at))


def cell_bar(value: Column) -> Column:
    """Ten cells, filled in proportion."""
    return F.rpad(F.repeat(F.lit("█"), F.bround(value * 10).cast("int")), 10, "░")


def snippet(text: Column, most: int = 300) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def preview(text: Column, most: int = 80) -> Column:
    return F.replace(F.substring(text, 1, most), F.lit("\n"), F.lit(" "))


def short_hash(item_id: Column, most: int = 8) -> Column:
    return F.substring(F.md5(item_id), 1, most)


def vector_text(judgment: Column, tags: Column) -> Column:
    """What of a memory is embedded: judgment, then tags."""
    joined = F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " ")
    return F.trim(F.concat_ws(" ", F.trim(F.coalesce(judgment, F.lit(""))), joined))


def semantic_core(judgment: Column, tags: Column) -> Column:
    return F.concat_ws(", ", judgment, F.array_join(tags, ", "))


def clean_model_name(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), r"[^A-Za-z0-9_.-]+", "_")


def dedupe_key(judgment: Column) -> Column:
    """Judgments that differ in case or white space only have one key."""
    return F.lower(collapse_space(F.coalesce(judgment, F.lit(""))))


def content_text(content: Column) -> Column:
    """Text of a message whose content is plain, or a JSON array of parts: then its first text part."""
    parts = F.from_json(content, "array<struct<type:string,text:string>>")
    first = F.element_at(F.filter(parts, lambda p: p["type"] == "text"), 1)["text"]
    return F.when(F.startswith(F.ltrim(content), F.lit("[")) & parts.isNotNull(), F.coalesce(F.when(F.size(F.filter(parts, lambda p: p["type"] == "text")) > 0, first), F.lit(""))).otherwise(content)


def coerce_timestamp(value: Column, default: Column) -> Column:
    """Epoch seconds from a number, a numeric text or an ISO text."""
    iso = F.try_to_timestamp(value).cast("double")
    return F.coalesce(value.try_cast("double"), iso, default)


def day_bucket(created_at: Column) -> Column:
    return (created_at / 86400).cast("long")


def memory_age(created_at: Column, now: float) -> Column:
    """How long ago a memory was made, in the largest whole unit up to months of 30 days; empty without a time."""
    s = F.lit(now) - created_at
    whole = lambda unit: F.floor(s / unit).cast("long").cast("string")
    text = F.when(s < 60, "（刚刚）").when(s < 3600, F.concat(F.lit("（"), whole(60), F.lit("分钟前）"))).when(s < 86400, F.concat(F.lit("（"), whole(3600), F.lit("小时前）")))
    text = text.when(s < 2592000, F.concat(F.lit("（"), whole(86400), F.lit("天前）"))).otherwise(F.concat(F.lit("（"), whole(2592000), F.lit("个月前）")))
    return F.when(F.coalesce(created_at, F.lit(0.0)) > 0, text).otherwise("")
