"""Main text of web pages: subtrees that recur over a site's pages go, then what HTML itself names as no article."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefield.llm.shared import cut

#: A start tag; one that the page's end cuts off takes the rest. Quantifiers are possessive, so no character is read twice.
START = re.compile(r"""<([a-zA-Z][^\s/>]*+)((?>[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)(?:>|\Z)""")
NAMED = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
# Elements by their use in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
DROPPED = frozenset("head nav footer aside button select option svg math canvas object audio video dialog menu".split())
#: Hide their text too, but not when they stand around an article.
AROUND = frozenset("form fieldset header".split())
#: Elements that end an open one of the same set when they begin.
ENDING = {**dict.fromkeys(("dt", "dd"), ("dt", "dd")), **dict.fromkeys(("td", "th"), ("td", "th")), "li": ("li",), "tr": ("tr", "td", "th"), "option": ("option",)}
#: Words of a class, id or role that name what is no part of an article.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login "
    "masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion related search share sharing sidebar signup "
    "social sponsor sponsored subscribe toolbar widget contentinfo complementary dialog alert".split()
)
#: A name that begins so tells what stands within or what is absent.
ABOUT = frozenset("has with without no is js hide hidden show".split())
WORDS = re.compile(r"[a-z]+")
#: Keep apart hashes of subtrees inside and outside articles, and of texts and skeletons.
IN_ARTICLE, SKELETON = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: A subtree is link-dense with so many links and so much of its text in them.
LEAST_LINKS, LINK_SHARE = 3, 0.8


def _is_boilerplate(tag: str, names: list[str]) -> bool:
    if tag in ("html", "body") or not names:
        return False
    if tag in ("article", "main"):
        return not BOILERPLATE.isdisjoint(names)
    for name in names:
        words = WORDS.findall(name)
        if words and words[0] not in ABOUT and not BOILERPLATE.isdisjoint(words):
            return True
    return False


class Tree(NamedTuple):
    """A subtree: hashes of its tags with its text, and of its tags and names alone where it is link-dense (else None); its blocks; those of the article around it."""

    text: int
    skeleton: int | None
    first: int
    last: int
    article: tuple[int, int] | None


class _Open:
    """An open element."""

    __slots__ = ("tag", "first", "text", "skeleton", "last_child", "hides", "article", "full", "holder", "chars", "linked", "links", "inline")

    def __init__(self, tag: str, names: list[str], first: int, hides: int, article: bool):
        self.tag, self.first, self.hides, self.article = tag, first, hides, article
        self.text, self.skeleton = xxhash.xxh64(tag), xxhash.xxh64(" ".join([tag, *names]))
        self.last_child, self.full, self.holder = None, False, article
        self.chars = self.linked = self.links = 0
        #: How many inline elements of each name stand open directly in it.
        self.inline: Counter[str] | None = None


def parse_page(page: str) -> tuple[list[str], list[bool], list[Tree]]:
    """(blocks, whether each is shown, subtrees): all text by block, whether tags and names let it stay, and the block-level subtrees with text.

    Shown is what stands in an article, or anywhere where a page has none, outside elements that HTML or their names give as boilerplate.
    A named wrapper, a form or a header around an article hides nothing, and where names would hide all that tags leave, they hide nothing.
    An article, what one stands in, and the page itself are no subtrees. An unclosed element ends with the nearest one around it
    that is closed, a paragraph with the next block. Each character is read a bounded number of times.
    """
    blocks: list[str] = []
    inside: list[bool] = []
    # The innermost hiding element around each block (0: none); each knows the one around it, so a block costs one number, however deep it stands.
    causes: list[int] = []
    # Those that turn out to stand around an article.
    forgiven: set[int] = set()
    hiding: list[int] = [0]
    around, strength = [0], [0]  # of hiding elements; 1: by a name, 2: by its tag, 3: by its tag, whatever it holds
    dropped = 0
    trees: list[Tree] = []
    waiting: list[list[Tree]] = []  # subtrees of each open article, until its last block is known
    run: list[str] = []
    stack: list[_Open] = []
    # Places of open block elements in the stack, and how often each tag is open.
    block_at: list[int] = []
    is_open: Counter[str] = Counter()
    articles = links_open = 0

    def close_block() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            blocks.append(text)
            inside.append(articles > 0)
            causes.append(hiding[-1])

    def add(text: str) -> None:
        if text:
            run.append(text)
            own = text.strip()
            if stack and own:
                top = stack[-1]
                top.text.update(own)
                top.full = True
                top.chars += len(own)
                if links_open:
                    top.linked += len(own)

    def pop() -> None:
        nonlocal articles, links_open, dropped
        own = stack.pop()
        is_open[own.tag] -= 1
        up = stack[-1] if stack else None
        inline = own.tag in INLINE
        if inline:
            links_open -= own.tag == "a"
            if block_at:
                stack[block_at[-1]].inline[own.tag] -= 1
        else:
            close_block()
            block_at.pop()
        if own.hides:
            number = hiding.pop()
            dropped -= own.hides == 3
            if own.holder and own.hides < 3:
                forgiven.add(number)
        articles -= own.article
        if own.article:
            trees.extend(t._replace(article=(own.first, len(blocks))) for t in waiting.pop())
        digest, shape = own.text.intdigest(), own.skeleton.intdigest()
        if own.full and not own.holder and not inline and own.tag not in ("html", "body"):
            dense = own.links >= LEAST_LINKS and own.linked >= LINK_SHARE * own.chars
            salt = IN_ARTICLE if articles else 0
            tree = Tree((digest ^ salt) - (1 << 63), (shape ^ salt ^ SKELETON) - (1 << 63) if dense else None, own.first, len(blocks), None)
            if tree.first < tree.last:
                (waiting[-1] if articles else trees).append(tree)
        if up:
            up.holder |= own.holder
            up.chars += own.chars
            up.linked += own.linked
            up.links += own.links + (own.tag == "a")
            if own.full and not own.holder:
                up.text.update(b"\x01%d" % digest)
                up.full = True
            if shape != up.last_child:  # a row of like children counts as one
                up.skeleton.update(b"\x01%d" % shape)
                up.last_child = shape

    def pop_to(place: int) -> None:
        while len(stack) > place:
            pop()

    at, end = 0, len(page)
    while at < end:
        found = page.find("<", at)
        if found < 0:
            found = end
        text = page[at:found]
        add(html.unescape(text) if "&" in text else text)
        if found == end:
            break
        after = page[found + 1 : found + 2]
        if after in ("!", "?"):
            over = page.find("-->", found + 4) if page.startswith("<!--", found) else page.find(">", found)
            at = end if over < 0 else over + (3 if page.startswith("-->", over) else 1)
            continue
        if after == "/":
            if not page[found + 2 : found + 3].isalpha():
                over = page.find(">", found)
                at = end if over < 0 else over + 1
                continue
            over = page.find(">", found)
            at = end if over < 0 else over + 1
            tag = re.split(r"[\s/>]", page[found + 2 : min(at, found + 40)], maxsplit=1)[0].lower()
            if tag in INLINE:
                own = stack[block_at[-1]].inline if block_at else None
                if own[tag] if own is not None else is_open[tag]:
                    while stack[-1].tag != tag:
                        pop()
                    pop()
            elif is_open[tag]:
                while stack[-1].tag != tag:
                    pop()
                pop()
            else:
                close_block()
            continue
        start = START.match(page, found) if after.isalpha() and after.isascii() else None
        if start is None:
            add("<")
            at = found + 1
            continue
        at = start.end()
        tag = start[1].lower()
        if tag in RAW:
            if tag not in INLINE:
                close_block()
            over = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = over.end() if over else end
            continue
        if tag not in INLINE:
            if tag != "br" and block_at and stack[block_at[-1]].tag == "p":
                pop_to(block_at[-1])
            if tag in ENDING and block_at and stack[block_at[-1]].tag in ENDING[tag]:
                pop_to(block_at[-1])
                if tag == "tr" and block_at and stack[block_at[-1]].tag == "tr":
                    pop_to(block_at[-1])
            close_block()
        if tag in VOID or start[2].endswith("/") and tag in ("svg", "path"):
            continue
        names = [n for a, b, c in NAMED.findall(start[2]) for n in (a or b or c).lower().split()] if start[2] else []
        named = _is_boilerplate(tag, names)
        article = tag in ("article", "main") and not named and not dropped
        hides = 3 if tag in DROPPED or named and tag in ("article", "main") else 2 if tag in AROUND and not (tag == "header" and articles) else 1 if named else 0
        if hides:
            around.append(hiding[-1])
            hiding.append(len(strength))
            strength.append(hides)
            dropped += hides == 3
        articles += article
        if article:
            waiting.append([])
        own = _Open(tag, names, len(blocks), hides, article)
        if tag in INLINE:
            links_open += tag == "a"
            if block_at:
                stack[block_at[-1]].inline[tag] += 1
        else:
            own.inline = Counter()
            block_at.append(len(stack))
        stack.append(own)
        is_open[tag] += 1
    pop_to(0)
    close_block()
    worst = [0]
    for n in range(1, len(strength)):
        worst.append(max(worst[around[n]], 0 if n in forgiven else strength[n]))
    hidden = [worst[n] for n in causes]
    whole = any(i and h < 2 for i, h in zip(inside, hidden))
    least = min((h for h, i in zip(hidden, inside) if i or not whole), default=0)
    shown = [(i or not whole) and h <= min(least, 1) for i, h in zip(inside, hidden)]
    return blocks, shown, trees


HASH_PRIME, HASH_BASE = (1 << 61) - 1, 0x1F3D5B79
HOST = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)")
COUNTED = "host string, inside boolean, hash long, article long, content long"


def _host(url: str | None) -> str:
    return m[1].lower() if (m := HOST.match(url or "")) else ""


def _text_hash(blocks: Iterable[str]) -> int:
    return xxhash.xxh64_intdigest("\n".join(blocks)) - (1 << 63)


def _range_hashes(blocks: list[str], shown: list[bool], ranges: set[tuple[int, int]]) -> dict[tuple[int, int], int]:
    """A hash of the shown text of each range of blocks, from one pass over all of them: ranges may stand one in another."""
    before, power, total, step = [0], [1], [0], pow(HASH_BASE, -1, HASH_PRIME)
    for text, show in zip(blocks, shown):
        n = before[-1]
        before.append(n + show)
        if show:
            total.append((total[-1] + xxhash.xxh64_intdigest(text) % HASH_PRIME * power[-1]) % HASH_PRIME)
            power.append(power[-1] * HASH_BASE % HASH_PRIME)
    inverse = [1]
    for _ in range(len(power) - 1):
        inverse.append(inverse[-1] * step % HASH_PRIME)
    return {(a, b): (total[before[b]] - total[before[a]]) * inverse[before[a]] % HASH_PRIME ^ (before[b] - before[a]) for a, b in ranges}


def subtree_rows(url: str | None, page: str) -> set[tuple]:
    """(host, inside, hash, article, content) of a page's subtrees: ``content`` is a hash of the text that is shown, ``article`` of that in the nearest article around one.

    A row without a hash stands for the page itself, and one for its articles if it has some.
    """
    host = _host(url)
    blocks, shown, trees = parse_page(page)
    content = _text_hash(b for b, s in zip(blocks, shown) if s)
    articles = _range_hashes(blocks, shown, {t.article for t in trees if t.article})
    rows = {(host, False, None, None, content), *((host, True, None, None, content) for _ in articles)}
    for t in trees:
        rows.update((host, t.article is not None, value, articles.get(t.article), content) for value in (t.text, t.skeleton) if value is not None)
    return rows


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``subtree_rows`` of the pages of a batch, each row once."""
    for whole in batches:
        for first in range(0, len(whole), 500):
            batch = whole.slice(first, 500)
            rows = set().union(*(subtree_rows(url, page.as_py() or "") for page, url in zip(batch.column("html"), batch.column("url").to_pylist())))
            types = (pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["host", "inside", "hash", "article", "content"])


def recurring_subtrees(counted: DataFrame, least_pages: int, least_share: float) -> DataFrame:
    """(host, hash) of subtrees that enough different pages of the host have, and of those inside articles that enough different articles have.

    Pages and articles that show the same text count once, so that copies of one article do not make it a template.
    """
    each = lambda rows, *by: rows.select("host", "inside", "hash", *by).distinct().groupBy("host", "inside", "hash").agg(F.count("*").alias("n"))
    pages = each(counted, "content")
    often = pages.filter(F.col("hash").isNotNull() & (F.col("n") >= least_pages))
    articles = each(counted.filter(F.col("inside") & F.col("hash").isNotNull()), "article").filter(F.col("n") >= least_pages).select("host", "hash", F.col("n").alias("in_articles"))
    often = often.join(articles, ["host", "hash"], "left").filter("not inside or in_articles is not null")
    total = pages.filter("hash is null").select("host", "inside", F.col("n").alias("of"))
    often = often.join(total, ["host", "inside"]).filter(F.least("n", F.coalesce("in_articles", "n")) >= least_share * F.col("of"))
    return often.select("host", "hash")


def template_blocks(trees: list[Tree], recurring: frozenset[int] | set[int]) -> set[int]:
    """The blocks of the subtrees that recur on the page's host."""
    out, end = set(), 0
    for first, last in sorted({(t.first, t.last) for t in trees if t.text in recurring or t.skeleton in recurring}) if recurring else ():
        out.update(range(max(first, end), last))
        end = max(end, last)
    return out


def main_text(page: str, recurring: frozenset[int] | set[int] = frozenset()) -> tuple[str, int, int]:
    """(the article of one page without the subtrees whose hashes recur on its host, how many blocks the page has, how many of them recur)."""
    blocks, shown, trees = parse_page(page)
    gone = template_blocks(trees, recurring)
    return "\n".join(b for i, b in enumerate(blocks) if shown[i] and i not in gone), len(blocks), len(gone)


EXTRACTED = "page_id long, url string, text string, n_blocks long, n_template long"


def _extracted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), 500):
                batch = whole.slice(first, 500)
                found = [main_text(page.as_py() or "", shared.value.get(_host(url), frozenset())) for page, url in zip(batch.column("html"), batch.column("url").to_pylist())]
                columns = [pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 3, (pa.string(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *columns], names=["page_id", "url", "text", "n_blocks", "n_template"])

    return run


PARSED = "row long, page_id long, url string, host string, blocks array<string>, shown array<boolean>, trees array<struct<hash: long, first: int, last: int>>"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.list_(pa.string()), pa.list_(pa.bool_()), pa.list_(pa.struct([("hash", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]))]
    for whole in batches:
        for first in range(0, len(whole), 500):
            part = whole.slice(first, 500)
            pages = [parse_page(p or "") for p in part.column("html").to_pylist()]
            hosts = pa.array([_host(u) for u in part.column("url").to_pylist()], pa.string())
            trees = [[{"hash": h, "first": t.first, "last": t.last} for t in p[2] for h in (t.text, t.skeleton) if h is not None] for p in pages]
            arrays = [pa.array(c, k) for c, k in zip(([p[0] for p in pages], [p[1] for p in pages], trees), kinds)]
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("page_id"), part.column("url"), hosts, *arrays], names=["row", "page_id", "url", "host", "blocks", "shown", "trees"])


def _by_join(rows: DataFrame, often: DataFrame) -> DataFrame:
    """The same by a join of each page's subtrees with those that recur, for more of them than tasks should hold."""
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()).select("row", "page_id", "url", "html").mapInArrow(_parsed, PARSED), "parsed-pages")
    trees = rows.select("row", "host", F.explode("trees").alias("tree")).select("row", "host", "tree.*")
    gone = trees.join(often, ["host", "hash"]).groupBy("row").agg(F.collect_set(F.struct("first", "last")).alias("gone"))
    gone = rows.join(gone, "row", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<struct<first:int,last:int>>")))
    marked = F.transform(
        "blocks", lambda text, i: F.struct(text.alias("text"), F.get("shown", i).alias("shown"), F.exists("gone", lambda g: (g["first"] <= i) & (i < g["last"])).alias("gone"))
    )
    gone = gone.withColumn("marked", marked)
    text = F.array_join(F.transform(F.filter("marked", lambda b: b["shown"] & ~b["gone"]), lambda b: b["text"]), "\n")
    return gone.select("page_id", "url", text.alias("text"), F.size("marked").cast("long").alias("n_blocks"), F.size(F.filter("marked", lambda b: b["gone"])).cast("long").alias("n_template"))


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = 4, least_share: float = 0.3, most_held: int = 1_000_000
) -> DataFrame:
    """The article of each page: page_id, url, text, n_chars, n_blocks (blocks of the whole page), n_template (those that recur on its host).

    Every block-level subtree with text is hashed, hidden or not: its tags with its text, and, where nearly all of its text is in links, its tags and names
    without the text. Subtrees outside an ``article`` or ``main`` are counted over the host's pages of different text, those inside over
    its different articles; one that stands in ``least_pages`` and ``least_share`` of them is deleted with all its blocks.
    Then what HTML itself or its names give as boilerplate goes, as ``parse_page`` says. Blocks stand in page order, one a line.
    A null page is empty; a null or odd url is of the host ''. Repeated rows and ids are rows like others; an empty table gives an empty one.
    Up to ``most_held`` recurring hashes go to every task; more meet the pages by a join.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    counted = cut(rows.select("url", "html").mapInArrow(_counted, COUNTED).distinct(), "subtrees")
    often = cut(recurring_subtrees(counted, least_pages, least_share), "recurring-subtrees")
    if often.limit(most_held + 1).count() <= most_held:
        held: dict[str, set[int]] = {}
        for host, value in often.collect():
            held.setdefault(host, set()).add(value)
        out = rows.mapInArrow(_extracted(pages.sparkSession.sparkContext.broadcast(held)), EXTRACTED)
    else:
        out = _by_join(rows, often)
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_blocks", "n_template")
