"""HTML extraction by template deduction: what the pages of a host share is its template, what is left in its slots is text.

A page becomes a stream of tokens: block elements as they open and close, told apart by their path of
names and classes, and texts of blocks with their path. Of a host's pages, tokens with the same
occurrence vector (how often they are on each page) are one equivalence class. Tokens that change
places among those of their class leave it, and a class is valid where it stands in the same gap of the
class around it on all pages; valid classes, nested in each other's gaps, are the host's template
(``templates``). A page's text is what its slots
hold: texts that belong to the template are left out, and so are slots whose enclosing template elements
say by name, role or class that they are menus, headers, footers, sidebars, notices, adverts, forms or
comments. If a page has articles, their slots alone count; else its main element, else one named
after content, else all that is left but blocks of links.

A text is only taken for the template's if at least SHARE of the host's pages have it and these pages have at
least FEWEST different articles, so copies of an article never make its text a template, and on hosts
with few pages no text is taken away that way.

Classes are made by grouping in Spark: vectors are compared by 64 bits of hashes and support. A
host's pages are never gathered; the template of a host has no more tokens than about twice those of
its mean page. It goes to the pages by a broadcast join where all templates are small enough, else
by a shuffle that Spark splits where a host is hot.

A null page is an empty one and gives an empty text; so do pages without text. Null and odd urls have no
host, so no template. Repeated rows are rows of their own, other columns are left out, an empty table
gives no rows, and pages of any length, broken ones too, are read whole. Character references are
decoded; white space inside a block, line breaks included, becomes one space.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Template tokens are on so great a share of the host's pages, and on so many at least.
SHARE, LEAST_PAGES = 0.5, 3
#: Texts are the template's only if pages with so many different articles have them.
FEWEST = 8
#: Templates of all hosts are broadcast up to so many bytes (8 a token).
BROADCAST_BYTES = 32_000_000

# Fixed values of HTML: elements without content, with raw content, that start a block, and that end an open one of the same kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table", "tbody", "thead", "tfoot")), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select", "datalist"))}
#: A paragraph is not closed from inside these.
SCOPES = frozenset("table td th caption button object html".split())

#: Elements and roles that never hold main text.
NOISE = frozenset("aside audio button canvas datalist dialog footer form head iframe map menu nav noscript object script search select style svg template textarea title video".split())
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Words of classes and ids. Those of OWN also hold for articles and for what encloses one; the others only name a part of a page if no article is inside.
OWN = frozenset("ad ads adslot advert adverts advertisement advertisements advertising comment comments commentlist discussion disqus promo promoted promotion recommendation recommendations recommended related reply replies respond sponsor sponsored widget".split())
PARTS = frozenset("alert banner breadcrumb breadcrumbs consent cookie cookies copyright footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup search share sharing sidebar signup skip social subscribe subscription toolbar topbar".split())
CONTENT = re.compile(r"\b(?:article|entry|post|page|story|main|body)[-_ ]?(?:body|content|text)\b|\b(?:content|story|maintext|articlebody)\b|(?:^|\s)(?:article|entry|main|post)(?=\s|$)", re.I)

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^"'>])*)>?|<[!?/][^>]*>?|(?P<text>[^<]+|<)""", re.S)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|itemprop|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s/>]|$))""", re.I)
WORD_ENDS = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
RAW_ENDS = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in RAW}


@dataclass
class Element:
    name: str
    path: int
    #: 0: none; 1: lifted by an article inside; 2: not.
    noise: int = 0
    #: 3: article, 2: main, 1: named after content.
    main: int = 0
    link: bool = False


@dataclass
class Block:
    token: int
    text: str
    main: int
    links: bool


@dataclass
class Page:
    #: Elements and texts in page order.
    tokens: list[int] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)

    def kept(self) -> list[Block]:
        """The blocks of the slots that count."""
        most = max((b.main for b in self.blocks), default=0)
        return [b for b in self.blocks if b.main == most and (most or not b.links)]


_PATHS: dict[tuple[int, str], int] = {}


def _path(above: int, step: str) -> int:
    found = _PATHS.get((above, step))
    if found is None:
        if len(_PATHS) > 200_000:
            _PATHS.clear()
        found = _PATHS[above, step] = xxhash.xxh64_intdigest(f"{above}/{step}") >> 1
    return found


def _attributes(source: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(source)} if source.strip(" /\n\t\r") else {}


def _element(name: str, source: str, above: Element) -> Element:
    found = _attributes(source)
    noise, main, own = above.noise, above.main, 0
    if name in NOISE:
        own = 1 if name in ("form", "dialog") else 2
    elif name == "header" and not above.main:
        own = 1
    if found:
        names = f"{found.get('class', '')} {found.get('id', '')}"
        words = {w.lower() for w in WORD_ENDS.split(names)}
        role = found.get("role", "").lower()
        if name not in ("html", "body", "main") and not words.isdisjoint(OWN) or "hidden" in found or re.search(r"display\s*:\s*none", found.get("style", "")):
            own = 2
        elif name not in ("html", "body", "main", "article") and not own and (not words.isdisjoint(PARTS - {"header"} if above.main else PARTS) or role in NOISE_ROLES):
            own = 1
        if not own and not main:
            main = 2 if role == "main" else 1 if found.get("itemprop", "").lower() == "articlebody" or name not in ("html", "body") and CONTENT.search(names) else 0
    if not own and name in ("article", "main"):
        main = max(main, 3 if name == "article" else 2)
        noise = 0 if noise == 1 else noise
    step = name
    if name in BLOCKS:
        step += "." + re.sub(r"\d+", "0", found["class"]) if "class" in found else ""
    return Element(name, _path(above.path, step) if name in BLOCKS else above.path, max(noise, own), main, above.link or name == "a")


def read(source: str | None) -> Page:
    """A page's tokens, and its blocks of text that are in no part that a name rules out."""
    page, source, at = Page(), source or "", 0
    stack = [Element("", 0)]
    texts: list[str] = []
    owner, main, links = 0, 0, True

    def ended() -> None:
        nonlocal links, main
        text = " ".join("".join(texts).split())
        if text:
            token = xxhash.xxh64_intdigest(f"{owner}={text}") >> 1
            page.tokens.append(token)
            page.blocks.append(Block(token, text, main, links))
        texts.clear()
        links, main = True, 0

    def popped(to: int) -> None:
        while len(stack) > to:
            gone = stack.pop()
            if gone.name in BLOCKS:
                ended()
                if not gone.noise:
                    page.tokens.append(gone.path ^ 1 << 62)

    def close(names: str, scope: tuple | frozenset) -> None:
        wanted = names.split()
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in wanted:
                return popped(k)
            if stack[k].name in scope:
                return None

    while at < len(source):
        m = TOKEN.match(source, at)
        at = m.end()
        name = m["name"]
        if name is None:
            top = stack[-1]
            if m["text"] and not top.noise:
                text = html.unescape(m["text"])
                texts.append(text)
                if not text.isspace():
                    owner, main, links = top.path, max(main, top.main), links and top.link
            continue
        name = name.lower()
        if m["end"]:
            if name == "br":
                texts.append(" ")
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    popped(k)
                    break
                if stack[k].name in ("td", "th", "table") and name not in BLOCKS:
                    break
            continue
        if name == "br" or name in VOID and name not in BLOCKS:
            if name == "br":
                texts.append(" ")
            continue
        if name in BLOCKS:
            ended()
            if name in CLOSES:
                close(*CLOSES[name])
            else:
                close("p", SCOPES)
        if name in VOID:
            continue
        element = _element(name, m["attrs"], stack[-1])
        if name in RAW:
            end = RAW_ENDS[name].search(source, at)
            at = end.start() if end else len(source)
            if end:
                at = TOKEN.match(source, at).end()
            continue
        if m["attrs"].endswith("/") and name not in BLOCKS:
            continue
        stack.append(element)
        if name in BLOCKS and not element.noise:
            page.tokens.append(element.path)
    ended()
    popped(1)
    return page


def coded(pages: DataFrame) -> DataFrame:
    """host, page, article (a hash of the page's kept texts), tokens in order and times (how often a token is on the page, at its first place; else 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part, rows = batch.slice(k, 256), {"host": [], "article": [], "tokens": [], "times": []}
                for host, source in zip(part.column(0).to_pylist(), part.column(1)):
                    page = read(source.as_py())
                    left = Counter(page.tokens)
                    rows["host"].append(host)
                    rows["article"].append(xxhash.xxh64_intdigest("\n\n".join(b.text for b in page.kept())) >> 1)
                    rows["tokens"].append(page.tokens)
                    rows["times"].append([left.pop(t, 0) for t in page.tokens])
                kinds = {"host": pa.string(), "article": pa.int64(), "tokens": pa.list_(pa.int64()), "times": pa.list_(pa.int32())}
                yield pa.RecordBatch.from_pydict({c: pa.array(v, kinds[c]) for c, v in rows.items()})

    return pages.where("host <> ''").select("host", "html").mapInArrow(run, "host string, article long, tokens array<long>, times array<int>")


def host_of(url) -> F.Column:
    """The host of a url, lower-cased; empty if it has none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def classes(streams: DataFrame) -> DataFrame:
    """host, support, vector, tokens, articles: the equivalence classes, with a bitmap of their pages' articles (as many bits as different articles, or fewer)."""
    hosts = streams.groupBy("host").agg(F.count("*").alias("pages"))
    each = streams.select("host", "page", "article", F.inline(F.arrays_zip("tokens", "times"))).where("times > 0").withColumnRenamed("tokens", "token")
    vectors = each.groupBy("host", "token").agg(F.count("*").alias("support"), F.bit_xor(F.xxhash64("page", "times")).alias("vector"), F.bit_or(F.expr("shiftleft(1L, int(pmod(article, 64)))")).alias("articles"))
    common = vectors.where(F.col("support") >= LEAST_PAGES).join(hosts, "host").where(F.col("support") >= SHARE * F.col("pages"))
    return common.groupBy("host", "support", "vector").agg(F.sort_array(F.collect_list("token")).alias("tokens"), F.max("articles").alias("articles"))


def _sent(rows: DataFrame, small: DataFrame, size: int) -> DataFrame:
    """rows with the columns of their host's row in small; size: tokens in small, which is broadcast if they are few."""
    return rows.join(F.broadcast(small) if 8 * size <= BROADCAST_BYTES else small.hint("merge"), "host", "left")


def _by_class(tokens: list[int], known: dict[int, int]) -> dict[int, list[int]]:
    """The places of each class's tokens on a page."""
    places: dict[int, list[int]] = {}
    for at, token in enumerate(tokens):
        if token in known:
            places.setdefault(known[token], []).append(at)
    return places


def _ranks(tokens: list[int], known: dict[int, int], _: list[int]) -> list[tuple[int, int]]:
    """(token, rank): where each token of a class stands among the class's tokens; several ranks if a repeated class doesn't come in one order."""
    out = set()
    for at in _by_class(tokens, known).values():
        seen = [tokens[k] for k in at]
        unit = len(set(seen))
        out.update((token, k % unit) for k, token in enumerate(seen))
    return list(out)


def _nested(tokens: list[int], known: dict[int, int], supports: list[int]) -> list[tuple[int, int, int]]:
    """(class, parent, gap) of each class on a page: the tightest gap of another class around all its tokens; gap k comes after the parent's token k."""
    places, out = _by_class(tokens, known), []
    for c, at in places.items():
        best = (len(tokens) + 1, -1, 0)
        for d, around in places.items():
            unit = len({tokens[k] for k in around})
            if d == c or unit < 2 or supports[d] < supports[c] or around[0] > at[0] or around[-1] < at[-1]:
                continue
            gaps = {(bisect_right(around, p) - 1) % unit for p in at}
            if len(gaps) == 1 and (gap := gaps.pop()) < unit - 1:
                first = bisect_right(around, at[0]) - 1
                best = min(best, (around[first + 1] - around[first], d, gap))
        out.append((c, best[1], best[2]))
    return out


def _over_pages(streams: DataFrame, by_host: DataFrame, size: int, of: Callable[[list[int], dict[int, int], list[int]], list[tuple]], kinds: dict[str, pa.DataType]) -> DataFrame:
    """host and the distinct rows that ``of`` gives for its pages, each page with its tokens, the class of each and the classes' supports."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: dict[str, tuple] = {}
        for batch in batches:
            rows = set()
            for host, tokens, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if not own.is_valid:
                    continue
                if host not in told:
                    if len(told) > 1000:
                        told.clear()
                    listed = own.as_py()
                    told[host] = {t: c for c, x in enumerate(listed) for t in x["tokens"]}, [-x["s"] for x in listed]
                rows.update((host, *x) for x in of(tokens, *told[host]))
            cols = list(zip(*rows)) or [()] * (1 + len(kinds))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), *kinds.values()))], ["host", *kinds])

    schema = ", ".join(f"{c} {'long' if k == pa.int64() else 'int'}" for c, k in kinds.items())
    return _sent(streams.select("host", "tokens"), by_host, size).select("host", "tokens", "classes").mapInArrow(run, f"host string, {schema}")


def _listed(found: DataFrame) -> DataFrame:
    """host and its classes, the most common first; a class's number is its place."""
    return found.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("support")).alias("s"), "tokens", "articles"))).alias("classes"))


def templates(pages: DataFrame) -> DataFrame:
    """A row for each valid class: host, class, support, tokens, articles, parent (the class around it, -1 at the top) and gap (after which of the parent's tokens).

    pages has the columns host and html. Tokens that change places among those of their class are in no valid class.
    """
    streams = written(coded(pages), "page-tokens").withColumn("page", F.monotonically_increasing_id())
    found = written(classes(streams), "page-classes")
    size = found.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    ranks = _over_pages(streams, _listed(found), size, _ranks, {"token": pa.int64(), "rank": pa.int32()})
    steady = ranks.groupBy("host", "token").agg(F.min("rank").alias("rank"), F.max("rank").alias("most")).where("rank = most").select("host", "token", "rank")
    each = found.select("host", "support", "vector", "articles", F.explode("tokens").alias("token")).join(steady, ["host", "token"])
    ordered = each.groupBy("host", "support", "vector").agg(F.max("articles").alias("articles"), F.transform(F.sort_array(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]).alias("tokens"))
    by_host = written(_listed(ordered), "page-ordered")
    seen = _over_pages(streams, by_host, size, _nested, {"class": pa.int32(), "parent": pa.int32(), "gap": pa.int32()})
    same = seen.groupBy("host", "class").agg(*[f(c).alias(f"{n}_{c}") for c in ("parent", "gap") for n, f in (("least", F.min), ("most", F.max))])
    valid = same.where("least_parent = most_parent and least_gap = most_gap").select("host", "class", F.col("least_parent").alias("parent"), F.col("least_gap").alias("gap"))
    numbered = by_host.select("host", F.posexplode("classes").alias("class", "c"))
    return numbered.join(valid, ["host", "class"]).select("host", "class", (-F.col("c.s")).alias("support"), "c.tokens", "c.articles", "parent", "gap")


def extracted(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars."""
    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    shared = templates(pages).where(F.bit_count("articles") >= FEWEST)
    shared = written(shared.groupBy("host").agg(F.flatten(F.collect_list("tokens")).alias("shared")), "page-templates")
    size = shared.agg(F.coalesce(F.sum(F.size("shared")), F.lit(0))).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part, texts = batch.slice(k, 256), []
                for source, own in zip(part.column(2), part.column(3)):
                    left_out = frozenset(own.as_py() or ())
                    texts.append("\n\n".join(b.text for b in read(source.as_py()).kept() if b.token not in left_out))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    return _sent(pages, shared, size).select("page_id", "url", "html", "shared").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op13_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
