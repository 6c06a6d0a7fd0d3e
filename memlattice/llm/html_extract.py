"""Main-text extraction by template deduction from equivalence classes.

Pages of one host are made from a template.  Its tokens, element paths and the texts that stand at them, occur in
step: a token's occurrence vector says how often each page of the host has it, and tokens with the same
vector form an equivalence class (Arasu and Garcia-Molina's ExAlg).

* A page sends one row a distinct token, of the text inside articles as well.  Pages of a host with the same text count once.  A vector is
  named by the sum over pages of hash(page, count), which combines like any sum, so a host with a third of all pages is never gathered.
* Classes with enough support are valid if their tokens nest: the element that holds a token has a valid class too.  Valid
  classes make up the template; what stands between its tokens are slots.
* Texts that are template tokens themselves are fixed and go, in articles too.  Slots inside elements that say they are menus, adverts and so
  on go.  Of the other slots those in article elements stay, and those in the deepest element of the template that holds most
  of the text of the host's slots, unless that is around an article.
* Hosts of fewer than PAGES different pages have no template; for them the article element alone decides, and without one all slots stay.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlattice.llm.common import Scratch, text_or_empty

#: Elements whose text is never part of an article.
DROPPED = frozenset("nav header footer aside form script style noscript template head title iframe svg canvas object select button textarea input option datalist dialog menu math audio video".split())
#: Words in class, id and role that mark such elements, unless they are a container: an article, an element around one or around a
#: headline of one, or, outside articles, an element with half of the page's text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner banners sidebar side menu menubar nav navbar navigation breadcrumb breadcrumbs header masthead topbar "
    "footer foot bottombar cookie cookies consent gdpr notice notices alert notification popup modal overlay newsletter subscribe signup login share sharing social related recommended recommendations "
    "widget comment comments respond reply replies disqus toolbar pagination pager copyright search complementary contentinfo".split()
)
#: The words among them that mark an element of running text.
ADVERTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner banners".split())
#: Elements nested deeper than this share the path of the one at this depth.
DEEP = 256
#: Elements that hold an article.
ARTICLE = ("article", "main")
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
TEXT_BLOCKS = tuple("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre tr td th tbody thead tfoot figure figcaption caption center address details summary".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an open one of the same kind ends, and the elements that this stays inside of.
_ENDS = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|([^<]+|<)",
    re.S,
)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")
#: Names that say what an element comes with, not what it is.
_WITH = re.compile(r"(?<!\S)(?:has|with|without|no)[-_]\S+")
#: Share of a host's pages, and number of them, that a template token needs.
SUPPORT, PAGES = 0.6, 3


class Slot:
    """A run of text: path of its element, text, and whether it is marked as no part of an article or is in one."""

    __slots__ = ("path", "text", "dropped", "article")

    def __init__(self, path, text, dropped, article):
        self.path, self.text, self.dropped, self.article = path, text, dropped, article


class Mark:
    """An element that words mark: whether it is in an article, whether it is a container, and the characters in it."""

    __slots__ = ("article", "container", "chars")

    def __init__(self, article):
        self.article, self.container, self.chars = article, False, 0


def _marked(attrs: str, words: frozenset = MARKS) -> tuple[str, bool]:
    """What a path says of class, id and role; whether they mark the element."""
    said, bad = [], False
    for m in _ATTR.finditer(attrs):
        value = m[2] or m[3] or m[4] or ""
        said.append(re.sub(r"[0-9]+", "0", value.strip()))
        if any(w.lower() in words for w in _WORDS.findall(_WITH.sub("", value))):
            bad = True
    return "." + ".".join(said) if said else "", bad


def parse(source: str) -> tuple[list[Slot], dict[str, int]]:
    """The slots in page order and how often each element path occurs; missing and stray end tags are put up with.

    One pass over the page: after the last ">" there is no tag, so tags that never end are looked for once.  An element of running text
    is no slot of its own unless it is marked as an advert.
    """
    slots: list[Slot] = []
    counts: dict[str, int] = {}
    stack: list[tuple[str, str, bool, bool, tuple]] = []  # name, path, dropped, in an article, elements around that words mark
    marked: list[tuple[Slot, tuple]] = []
    held: list[str] = []

    def flush():
        if held:
            text = "".join(held)
            held.clear()
            if text and not text.isspace():
                _, path, dropped, article, marks = stack[-1] if stack else ("", "", False, False, ())
                slots.append(Slot(path, text, dropped, article))
                if marks and not dropped:
                    marked.append((slots[-1], marks))

    at, end, last = 0, len(source), source.rfind(">")
    inner: list[list] = []  # open advert elements of running text: depth of the stack, elements of the same name inside
    while at < end:
        if at > last:
            held.append(html.unescape(source[at:]))
            break
        m = _TOKEN.match(source, at)
        if m is None:  # a tag that never ends
            held.append(source[at])
            at += 1
            continue
        at = m.end()
        if m[4] is not None:
            held.append(html.unescape(m[4]) if "&" in m[4] else m[4])
            continue
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name in INLINE:
                if inner and inner[-1][0] == len(stack) and stack[-1][0] == name:
                    inner[-1][1] -= 1
                    if not inner[-1][1]:
                        flush()
                        inner.pop()
                        stack.pop()
                continue
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            while inner and inner[-1][0] > len(stack):
                inner.pop()
            continue
        if name in INLINE:
            if name in VOID or m[3].endswith("/"):
                continue
            if inner and inner[-1][0] == len(stack) and stack[-1][0] == name:
                inner[-1][1] += 1
            elif m[3] and _marked(m[3], ADVERTS)[1]:
                flush()
                _, path, dropped, article, marks = stack[-1] if stack else ("", "", False, False, ())
                stack.append((name, path, dropped, article, (*marks, Mark(article))))
                inner.append([len(stack), 1])
            continue
        flush()
        if name in VOID or m[3].endswith("/"):
            continue
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in _ENDS.get(name, ()):
                del stack[k:]
                break
            if stack[k][0] not in ("p", "li", "td", "th", "dt", "dd", "option"):
                break
        while inner and inner[-1][0] > len(stack):
            inner.pop()
        said, bad = _marked(m[3]) if m[3] else ("", False)
        _, path, dropped, article, marks = stack[-1] if stack else ("", "", False, False, ())
        if len(stack) < DEEP:
            path = f"{path}/{name}{said}"
        counts[path] = counts.get(path, 0) + 1
        # a header inside an article may hold its headline
        dropped = dropped or (name in DROPPED and not (name == "header" and article))
        # an article inside another, as of a comment, is no container
        outer = name in ARTICLE and not (article and any(x[0] == "article" for x in stack))
        if outer or (name == "h1" and article):
            for k in marks:
                k.container = True
        if name in _RAW:
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at)
            at = close.end() if close else end
            continue
        if bad and not dropped and name not in ("html", "body") and not outer:
            marks = (*marks, Mark(article))
        stack.append((name, path, dropped, article or name in ARTICLE, marks))
    flush()
    if marked:
        for s, marks in marked:
            for k in marks:
                k.chars += len(s.text)
        whole = sum(len(s.text) for s in slots if not s.dropped)
        for s, marks in marked:
            s.dropped = any(not k.container and (k.article or 2 * k.chars < whole) for k in marks)
    return slots, counts


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For every page the distinct tokens: (host, path, text or not, name of the page by its text, count, characters of slots inside)."""
    for b in batches:
        rows: list[tuple] = []
        seen = set()
        for host, source in zip(b["host"], b["html"], strict=True):
            slots, counts = parse(source)
            texts = [(s.path, " ".join(s.text.split())) for s in slots if not s.dropped]
            page = _hash(*(t for _, t in texts), *counts)
            if (host, page) in seen:
                continue
            seen.add((host, page))
            own = {"": [0, 1]} | {path: [0, n] for path, n in counts.items()}
            fixed: dict[tuple[str, str], int] = {}
            for path, text in texts:
                fixed[path, text] = fixed.get((path, text), 0) + 1
                while path:
                    own.setdefault(path, [0, 0])[0] += len(text)
                    path = path.rpartition("/")[0]
            rows.extend((host, path, None, page, n, chars) for path, (chars, n) in own.items())
            rows.extend((host, path, _hash(text), page, n, 0) for (path, text), n in fixed.items())
        yield pd.DataFrame(rows, columns=["host", "path", "text", "page", "n", "chars"], dtype=object)


def templates(pages: DataFrame) -> DataFrame:
    """(host, main, fixed): paths of the main element, and (path, text) tokens of the template as hashes, of each host."""
    seen = pages.mapInPandas(_tokens, "host string, path string, text long, page long, n long, chars long")
    # copies of a page say nothing of the template
    once = seen.groupBy("host", "path", "text", "page").agg(F.max("n").alias("n"), F.max("chars").alias("chars")).withColumn("vector", F.xxhash64("page", "n"))
    # vectors wrap around at 64 bits; halves keep their sums from overflowing on the way
    low, high = F.col("vector").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright("vector", 32)
    token = once.groupBy("host", "path", "text").agg(
        F.count("*").alias("pages"), F.sum("chars").alias("chars"), F.sum(low).alias("lo"), F.sum(high).alias("hi")
    ).filter(F.col("pages") >= PAGES)
    token = Scratch(pages.sparkSession, "template").save(token.withColumn("depth", F.size(F.split("path", "/")) - 1))
    token = token.withColumn("vector", F.pmod(F.col("lo") + F.pmod(F.col("hi"), F.lit(1 << 31)) * F.lit(1 << 32) % F.lit(1 << 62), F.lit(1 << 62)))
    whole = (F.col("path") == "") & F.col("text").isNull()
    hosts = token.filter(whole).select("host", F.col("pages").alias("all_pages"))
    known = token.filter(~whole).join(hosts, "host").filter(F.col("pages") >= SUPPORT * F.col("all_pages"))
    classes = known.groupBy("host", "vector").agg(F.count("*").alias("size"), F.max("pages").alias("support"))
    member = known.join(classes, ["host", "vector"])
    # nested: the element around a token is itself in the template (with no less support: it is there whenever the token is)
    holder = member.filter("text is null").select("host", F.col("path").alias("around"), F.col("support").alias("around_support"))
    around = F.when(F.col("text").isNull(), F.regexp_extract("path", "^(.*)/[^/]*$", 1)).otherwise(F.col("path"))
    valid = (
        member.withColumn("around", around)
        .join(holder, ["host", "around"], "left")
        .filter((F.col("around") == "") | (F.col("around_support") >= F.col("support")))
    )
    most = F.max(F.when(F.col("text").isNull(), F.col("chars"))).over(Window.partitionBy("host"))
    scored = valid.withColumn("most", most)
    # elements of running text are no container of an article
    leaf = F.regexp_extract("path", r"/([a-z0-9]+)[^/]*$", 1).isin(*TEXT_BLOCKS)
    big = (F.col("text").isNull()) & ~leaf & (F.col("chars") > 0) & (F.col("chars") >= 0.5 * F.col("most"))
    return scored.groupBy("host").agg(
        F.max_by("path", F.struct(big.alias("big"), F.col("depth"), F.col("chars"), F.col("path"))).alias("main"),
        F.max(big).alias("has_main"),
        F.collect_set(F.when(F.col("text").isNotNull(), F.concat_ws("\t", "path", "text"))).alias("fixed"),
    )


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        texts = []
        for source, main, fixed in zip(b["html"], b["main"], b["fixed"], strict=True):
            slots, _ = parse(source)
            mine = [s for s in slots if not s.dropped]
            skip = set(fixed) if fixed is not None else set()
            mine = [s for s in mine if not skip or f"{s.path}\t{_hash(' '.join(s.text.split()))}" not in skip]
            under = [bool(main) and (s.path == main or s.path.startswith(main + "/")) for s in mine]
            if any(u and s.article for s, u in zip(mine, under, strict=True)):
                under = [False] * len(mine)
            inside = [s for s, u in zip(mine, under, strict=True) if s.article or u] or mine
            texts.append(" ".join(w for s in inside for w in s.text.split()))
        yield pd.concat([b[["page", "url"]], pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]}, index=b.index)], axis=1)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of ``pages``: its id, url, text and n_chars (code points).

    A null html counts as empty and gives an empty text.  Pages without a host, by a null or odd url, share the template of the
    empty host.  Rows that repeat are extracted alike.  Other columns of ``pages`` are not looked at.
    """
    slim = pages.select(
        F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), text_or_empty(html_col).alias("html")
    ).withColumn("host", host_of(F.col("url")))
    known = templates(slim.select("host", "html"))
    # written first, so that Spark knows its size: it is broadcast while that is small, else joined with skewed hosts split
    known = Scratch(pages.sparkSession, "html").save(known.select("host", F.when(F.col("has_main"), F.col("main")).alias("main"), "fixed"))
    out = slim.join(known, "host", "left").mapInPandas(_extract, "page long, url string, text string, n_chars long")
    return out.select(F.col("page").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
