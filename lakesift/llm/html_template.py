"""HTML extraction by equivalence classes of tokens across the pages of a host.

1. Every page is read as blocks: the path of its open block elements, its text, and how much of that is in links. A page's
   tokens are the paths of its block elements and the texts of its blocks with their paths.
2. A token's occurrence vector says how often each page of the host holds it. Vectors are kept as two
   sums of hashes of (page, count), which add up over tasks; tokens of a host with equal vectors
   are a class. Pages whose texts (without furniture) are equal count as one page, so copies make no template.
   A class has at least two tokens and spans at least `least_pages` pages; its tokens are the template's if they stand on
   `least_share` of the pages that have the path around them, so each layout of a host has a template.
3. Valid classes nest by their paths into the host's template: a class's parent holds the longest path above its own.
   Paths of the template are its slots.
4. The template is gone through from its root: as long as one slot below holds `MAIN_SHARE` of the text that differs
   between pages and isn't in links, stands once a page, and is of the same class or of one that is nested in it, that slot is entered. Where this
   ends is the host's content. Slots beside it are dropped, but for headings above it, whatever their names. Where it ends before any
   single element (`html`, `body`), slots that are mostly links are dropped as well.
5. Text that is itself a token of the template is the same on all pages and is dropped; inside of a marked article
   only where such text is at most `CONSTANT_SHARE` of the content, as pages that differ in little are near copies.

Names are the fallback: elements for menus, headers, footers, sidebars, notices, adverts, forms or comments are furniture by
their tag, role, class or id. Inside of the content a class or id must consist of such words alone (`ad`, `post-comments`,
not `ad-hoc`). Pages of hosts without a template, and pages without the host's content slot, take what a marked article (or main) element holds, or where one marks none all that is no furniture.
If the content lies inside of a marked article, the article is the content.

A page's tokens go through the shuffle once, by host and content, and then sums a token, so a host with a third of all
pages is no large group. A host's template is at most a few times the paths of its layouts. The templates are broadcast if their measured
size is at most `broadcast_bytes`; beyond that, pages are joined on the host, where Spark splits a skewed side.

Defined cases: a null page is empty and gives an empty text; a null url has the host ''; hosts with few pages have no
template, and their pages are judged by their own elements; a page that breaks off is read as far as it goes;
`br` is white space; equal rows are each given; an empty table gives an empty result; other columns aren't looked at.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakesift.llm.common import cut, table

LEAST_PAGES = 3
LEAST_SHARE = 0.5
BROADCAST_BYTES = 8 << 20
MAIN_SHARE = 0.8
CONSTANT_SHARE = 1 / 3
LINK_SHARE = 0.5

# Element names of HTML and the words that name page furniture.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr "
    "html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template svg math object canvas audio video".split())
FURNITURE_TAGS = frozenset("nav header footer aside form menu dialog head button select option optgroup datalist fieldset search".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promoted promotion nav navbar navigation menu menubar "
    "breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies consent gdpr notice notices notification popup modal overlay newsletter "
    "subscribe subscription signup login social share sharing related recommended recommendations comment comments disqus respond reply replies toolbar "
    "pagination pager widget widgets".split()
)
#: A name with one of these tells of the layout around furniture.
LAYOUT_WORDS = frozenset("with without has no layout grid column columns".split())
COMMENT_WORDS = frozenset("comment comments reply replies".split())
#: Words beside a word of furniture that leave a name furniture inside of the content.
NEUTRAL_WORDS = frozenset(
    "post posts article articles story stories news page site section box list item items container wrapper block area inner outer top bottom left right main "
    "bar button buttons link links user users reader readers text label title icon icons form thread count slot unit body content".split()
)
HEADING = re.compile(r"h[1-6]\b")
KEEPS = frozenset("html body main".split())
#: Elements that end when another of the second set begins.
ENDS = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
}
P_GOES_ON = frozenset("td th tr tbody thead tfoot caption option optgroup legend summary html body head".split())

_TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)"
    r"|<[a-zA-Z][^>]*+\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}
_PARTS = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_DIGITS = re.compile(r"\d+")


@dataclass
class Block:
    path: str
    text: str
    furniture: bool
    marked: bool
    #: Furniture by a tag, a role or a name that has no other meaning.
    strict: bool
    #: Characters in links.
    links: int


def _named_furniture(name: str, words: frozenset[str] = FURNITURE_WORDS) -> bool:
    parts = [x for x in _PARTS.split(name.lower()) if x]
    return bool(parts) and (parts[0] in words or parts[-1] in words) and not LAYOUT_WORDS.intersection(parts)


def _only_furniture(name: str) -> bool:
    """Whether a name consists of words of furniture and neutral ones, at least one of the former."""
    parts = [x for x in _PARTS.split(name.lower()) if x and not x.isdigit()]
    return any(x in FURNITURE_WORDS for x in parts) and all(x in FURNITURE_WORDS or x in NEUTRAL_WORDS for x in parts)


def _element(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """The element's label in a path, whether it may be furniture, and whether it is nothing else."""
    furniture, label = tag in FURNITURE_TAGS, tag
    strict = furniture
    if attributes.strip(" /"):
        got = {}
        for m in _ATTRIBUTE.finditer(attributes):
            got.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
        names = got.get("class", "").split()
        own = [got["id"]] if got.get("id") else []
        label += "".join(f".{_DIGITS.sub('#', x)}" for x in sorted(set(names))) + "".join(f"#{_DIGITS.sub('#', x)}" for x in own)
        role = got.get("role", "").lower()
        if role:
            label += f"@{role}"
        hidden = "hidden" in got or got.get("aria-hidden", "").lower() == "true" or "display:none" in got.get("style", "").replace(" ", "").lower()
        label += "!hidden" * hidden
        if tag not in KEEPS:
            words = COMMENT_WORDS if tag == "article" else FURNITURE_WORDS
            strict = strict or hidden or role in FURNITURE_ROLES
            furniture = strict or any(_named_furniture(x, words) for x in [*names, *own])
            strict = strict or (furniture and (tag == "article" or any(map(_only_furniture, [*names, *own]))))
    return label.replace(">", "-"), furniture, strict


def blocks(page: str, opened: dict[tuple[str, bool], int] | None = None) -> list[Block]:
    """The page's blocks of text, in order. opened: gets the number of elements in paths by (path, furniture)."""
    # Open elements: (tag, is a block, path, furniture, marked, furniture and nothing else, in a link)
    stack: list[tuple[str, bool, str, bool, bool, bool, bool]] = [("", True, "", False, False, False, False)]
    out: list[Block] = []
    held: list[str] = []
    linked = 0
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                _, _, path, furniture, marked, strict, _ = stack[-1]
                out.append(Block(path, text, furniture, marked, strict, min(linked, len(text))))
            held.clear()
            linked = 0

    def say(text: str) -> None:
        """Text stands in a block's list with the block's state; text of furniture inside a line is dropped."""
        nonlocal linked
        if text:
            if stack[-1][3] and not stack[-1][1]:
                return
            if stack[-1][6]:
                linked += len(text)
            held.append(html.unescape(text) if "&" in text else text)

    while at < end:
        m = _TAG.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag == "br":
            held.append(" ")
        elif closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    if any(x[1] for x in stack[k:]):
                        flush()
                    del stack[k:]
                    break
                if stack[k][1] and tag not in BLOCKS:
                    break
            else:
                if tag in BLOCKS:
                    flush()
        elif tag in RAW:
            if not attributes.rstrip().endswith("/") or tag not in ("svg", "math"):
                stop = _RAW_END[tag].search(page, at)
                at = stop.end() if stop else end
            if tag not in BLOCKS and tag in ("svg", "math", "object", "canvas", "audio", "video", "iframe"):
                held.append(" ")
        elif tag in VOID:
            if tag == "hr":
                flush()
        else:
            block = tag in BLOCKS
            if block:
                flush()
                for k in range(len(stack) - 1, 0, -1):
                    open_tag = stack[k][0]
                    if (open_tag == "p" and tag not in P_GOES_ON) or tag in ENDS.get(open_tag, ()):
                        del stack[k:]
                        break
                    if stack[k][1] and open_tag not in ENDS and open_tag != "p":
                        break
                if tag == "body":  # a head that was left open ends here
                    while stack[-1][0] == "head":
                        stack.pop()
            label, furniture, strict = _element(tag, attributes)
            _, _, path, outer, marked, outer_strict, link = stack[-1]
            if tag == "main":  # there's one, and it's never furniture
                outer = outer_strict = False
            furniture = strict if marked else furniture
            marked = marked or tag in ("article", "main") or "@main" in label
            state = (outer or furniture, marked, outer_strict or strict, link or tag == "a")
            # Furniture in a line is part of the path, so that a path is furniture everywhere or nowhere.
            here = f"{path}>{label}" if block or furniture else path
            stack.append((tag, block, here, *state))
            if opened is not None and (block or furniture):
                key = (here, state[0])
                opened[key] = opened.get(key, 0) + 1
    flush()
    return out


def _in_article(b: Block) -> bool:
    return b.marked and ">article" in b.path


def marked_kind(found: list[Block]) -> str:
    """The element that marks this page's article: 'article', 'main' or ''. Articles that hold less than half of main's text are teasers."""
    inside = [b for b in found if b.marked and not b.furniture]
    in_main = sum(len(b.text) for b in inside if ">main" in b.path or "@main" in b.path)
    in_article = sum(len(b.text) for b in inside if _in_article(b))
    if in_article and 2 * in_article >= in_main:
        return "article"
    return "main" if inside else ""


@dataclass(frozen=True)
class Template:
    """slots: its paths; content: the one that holds the article, or null if the host has no template; menus: slots of links; constant: its texts."""

    slots: frozenset[str] = frozenset()
    content: str | None = None
    menus: frozenset[str] = frozenset()
    constant: frozenset[int] = frozenset()
    #: Whether the template's texts go inside of a marked article too.
    everywhere: bool = False


def under(path: str, above: str) -> bool:
    return path == above or path.startswith(f"{above}>")


def slot_of(path: str, template: frozenset[str]) -> str | None:
    """The longest path of the template that the path is, or lies under."""
    while path not in template:
        path, found, _ = path.rpartition(">")
        if not found:
            return None
    return path


def _heads(path: str, content: str) -> bool:
    """Whether it is a heading that stands beside the content or what is around it."""
    around, _, last = path.rpartition(">")
    return bool(HEADING.match(last)) and under(content, around)


def article(found: list[Block], template: Template) -> list[str]:
    """The texts of the remaining slots."""
    out = []
    if template.content is None or not any(under(b.path, template.content) for b in found):
        kind = marked_kind(found)
        for b in found:
            inside = not kind or (b.marked and (kind == "main" or _in_article(b)))
            if inside and not b.furniture:
                out.append(b.text)
        return out
    content = template.content
    single = content.rpartition(">")[2] not in ("", "html", "body")
    for b in found:
        if not under(b.path, content):
            if b.furniture or not _heads(b.path, content) or text_token(b) in template.constant:
                continue
        elif (b.strict if single else b.furniture) or (text_token(b) in template.constant and (template.everywhere or not _in_article(b))):
            continue
        elif not single and not _in_article(b) and slot_of(b.path, template.menus) is not None:
            continue
        out.append(b.text)
    return out


def text_token(b: Block) -> int:
    return xxhash.xxh64_intdigest(f"{b.path}\n{b.text}".encode()) >> 1


def host_of(url: Column) -> Column:
    authority = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", "")


TOKENS = "path string, token long, furniture boolean, own long, base long, times long, chars long, links long, one long, two long"
PAGES = f"host string, content long, page long, tokens array<struct<{TOKENS.replace(' ', ':').replace(',:', ',')}>>"


def _path_hash(path: str) -> int:
    return xxhash.xxh64_intdigest(path.encode(), 2) >> 1


def page_tokens(page: str) -> tuple[str, dict[tuple[str, int, bool], list[int]]]:
    """What a page says without furniture, and its tokens: (path, text's token or 0, furniture) to (times, characters, those in links)."""
    opened: dict[tuple[str, bool], int] = {}
    found = blocks(page, opened)
    said = "\n".join(f"{b.path}\n{b.text}" for b in found if not b.furniture)
    tokens = {(path, 0, furniture): [n, 0, 0] for (path, furniture), n in opened.items()}
    tokens["", 0, False] = [1, 0, 0]
    for b in found:
        for key, times in (((b.path, 0, b.furniture), 0), ((b.path, text_token(b), b.furniture), 1)):
            sums = tokens.setdefault(key, [0, 0, 0])
            for k, x in enumerate((times, len(b.text), b.links)):
                sums[k] += x
    return said, tokens


def _page_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) to a row a page, with a hash of its texts that aren't furniture and its tokens.

    A path's token is 0. base: the path that the token's pages are a share of, which is a text's own path and the path around a path.
    """
    kinds = [pa.string(), pa.int64(), pa.bool_(), *[pa.int64()] * 7]
    token_type = pa.struct(list(zip([f.split()[0] for f in TOKENS.split(", ")], kinds)))
    for batch in batches:
        contents, ids, lists = [], [], []
        for page in batch.column(1).to_pylist():
            said, found = page_tokens(page or "")
            content = xxhash.xxh64_intdigest(said.encode(), 1)
            tokens = []
            for (path, token, furniture), (times, chars, links) in found.items():
                mixed = content.to_bytes(8, "little") + times.to_bytes(8, "little")
                own, base = (None, _path_hash(path)) if token else (_path_hash(path), _path_hash(path.rpartition(">")[0]))
                tokens.append((path, token, furniture, own, base, times, chars, links, zlib.crc32(mixed) >> 1, xxhash.xxh32_intdigest(mixed) >> 1))
            contents.append(content >> 1)
            ids.append(xxhash.xxh64_intdigest((page or "").encode()) >> 1)
            lists.append(tokens)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(contents, pa.int64()), pa.array(ids, pa.int64()), pa.array(lists, pa.list_(token_type))], names=["host", "content", "page", "tokens"]
        )


def counted(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, path, token, furniture, own, base, pages, times, chars, links, one, two): all paths, and the texts on so many pages; pages: (host, html).

    Pages of equal content count as one.
    """
    read = pages.select("host", "html").mapInArrow(_page_tokens, PAGES)
    distinct = read.groupBy("host", "content").agg(F.min_by("tokens", "page").alias("tokens"))
    tokens = distinct.select("host", F.inline("tokens")).groupBy("host", "path", "token", "furniture", "own", "base")
    sums = tokens.agg(F.count(F.lit(1)).alias("pages"), *[F.sum(c).alias(c) for c in ("times", "chars", "links", "one", "two")])
    return cut(sums.where((F.col("token") == 0) | (F.col("pages") >= least_pages)))


def classes(tokens: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, path, token, furniture, pages, times, class): the tokens of the valid classes of each host; tokens: what counted gives.

    A token's share is that of the pages with the path around it, so that a layout is judged by its own pages.
    """
    tokens = tokens.where(F.col("pages") >= least_pages)
    around = tokens.where(F.col("own").isNotNull()).groupBy("host", F.col("own").alias("base")).agg(F.max("pages").alias("around_pages"))
    alike = Window.partitionBy("host", "pages", "one", "two")
    shared = tokens.withColumn("alike", F.count(F.lit(1)).over(alike)).where(F.col("alike") >= 2)
    return (
        shared.join(around, ["host", "base"])
        .where(F.col("pages") >= F.col("around_pages") * least_share)
        .select("host", "path", "token", "furniture", "pages", "times", "chars", F.xxhash64("pages", "one", "two").alias("class"))
    )


def _prefixes() -> Column:
    """A path and those above it."""
    steps = F.split("path", ">")
    return F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), ">")))


def nested(found: DataFrame) -> DataFrame:
    """(host, class, pages, paths, parent): the valid classes of a host as a tree; a class's parent holds the longest path above its own.

    Above a path are its prefixes, so the tree is an equal join of prefixes with paths.
    """
    paths = found.where(F.col("token") == 0).select("host", "class", "pages", "path").distinct()
    above = paths.select("host", "class", F.col("path").alias("own"), _prefixes().alias("path")).where("path <> own")
    owners = paths.select("host", "path", F.col("class").alias("owner"))
    parent = above.join(owners, ["host", "path"]).where(F.col("owner") != F.col("class"))
    parent = parent.groupBy("host", "class").agg(F.max_by("owner", F.struct(F.length("path"), F.col("path"), F.col("owner"))).alias("parent"))
    listed = paths.groupBy("host", "class", "pages").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    return listed.join(parent, ["host", "class"], "left")


def slots(tokens: DataFrame, found: DataFrame) -> DataFrame:
    """(host, path, class, parent, furniture, once, chars, links, constant, deeper): the paths of a template with what stands at and below them.

    chars: characters on all pages; links: those in links; constant: those in texts of the template; deeper: those below the path.
    """
    below = tokens.where((F.col("token") == 0) & (F.col("chars") > 0)).select("host", _prefixes().alias("slot"), "path", "chars", "links")
    below = below.groupBy("host", F.col("slot").alias("path")).agg(
        F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.sum(F.when(F.col("path") != F.col("slot"), F.col("chars")).otherwise(0)).alias("deeper")
    )
    same = found.where(F.col("token") != 0).select("host", _prefixes().alias("slot"), "chars")
    same = same.groupBy("host", F.col("slot").alias("path")).agg(F.sum("chars").alias("constant"))
    paths = found.where(F.col("token") == 0).groupBy("host", "path", "class").agg(F.bool_and("furniture").alias("furniture"), F.bool_and(F.col("times") == F.col("pages")).alias("once"))
    tree = nested(found).select("host", "class", "parent")
    joined = paths.join(tree, ["host", "class"]).join(below, ["host", "path"], "left").join(same, ["host", "path"], "left")
    return joined.select("host", "path", "class", "parent", "furniture", "once", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("chars", "links", "constant", "deeper")])


def content_of(nodes: list[dict]) -> str | None:
    """The slot that holds the article; nodes: a host's rows of slots."""
    by = {n["path"]: n for n in nodes}
    paths, here = frozenset(by), min(by, key=lambda p: (p.count(">"), p), default=None)
    if here is None:
        return None
    children: dict[str, list[str]] = {}
    for path in by:
        above = slot_of(path.rpartition(">")[0], paths) if ">" in path else None
        if above is not None and above != path:
            children.setdefault(above, []).append(path)

    def mass(path: str) -> int:
        return max(0, by[path]["chars"] - by[path]["links"] - by[path]["constant"])

    while True:
        now = by[here]
        able = [
            c for c in children.get(here, ())
            if by[c]["once"] and not by[c]["furniture"] and by[c]["deeper"] and (by[c]["class"] == now["class"] or by[c]["parent"] == now["class"])
            and mass(c) and mass(c) >= MAIN_SHARE * mass(here)
        ]
        if not able:
            break
        here = max(able, key=lambda c: (mass(c), c))
    marked = re.match(r"(.*?>article[^>]*)(?:>|$)", here)
    return marked[1] if marked else here


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A host's slots and constant texts to its template."""
    for batch in batches:
        rows = []
        for host, nodes, constant in zip(*(c.to_pylist() for c in batch.columns)):
            content = content_of(nodes)
            by = {n["path"]: n for n in nodes}
            menus = [p for p, n in by.items() if n["chars"] and n["links"] >= LINK_SHARE * n["chars"] and not HEADING.match(p.rpartition(">")[2]) and not under(content, p)]
            inside = by.get(content, {"chars": 0, "constant": 0})
            rows.append((host, sorted(by), content, sorted(menus), constant, inside["constant"] <= CONSTANT_SHARE * inside["chars"]))
        kinds = [pa.string(), pa.list_(pa.string()), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=["host", *TEMPLATE])


TEMPLATE = ["slots", "content", "menus", "constant", "everywhere"]


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, slots, content, menus, constant, everywhere): a row for each host with a template."""
    tokens = counted(pages, least_pages)
    found = cut(classes(tokens, least_pages, least_share))
    node = F.struct("path", "class", "parent", "furniture", "once", "chars", "links", "constant", "deeper")
    nodes = slots(tokens, found).groupBy("host").agg(F.collect_list(node).alias("nodes"))
    texts = found.where(F.col("token") != 0).groupBy("host").agg(F.collect_set("token").alias("texts"))
    both = nodes.join(texts, "host", "left").select("host", "nodes", F.coalesce("texts", F.array().cast("array<long>")).alias("texts"))
    return both.mapInArrow(_decided, "host string, slots array<string>, content string, menus array<string>, constant array<long>, everywhere boolean")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, template = None, Template()
    for batch in batches:
        texts, chars, kept, tokens = [], [], [], []
        for page, *parts in zip(*(c.to_pylist() for c in batch.columns[2:])):
            if parts != last:
                last = parts
                names, content, menus, constant, everywhere = parts
                template = Template(frozenset(names or ()), content, frozenset(menus or ()), frozenset(constant or ()), bool(everywhere))
            found = article(blocks(page or ""), template)
            text = "\n".join(found)
            texts.append(text)
            chars.append(len(text))
            kept.append(len(found))
            tokens.append(len(template.slots) + len(template.constant))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(chars, pa.int64()), pa.array(kept, pa.int64()), pa.array(tokens, pa.int64())],
            names=["page_id", "url", "text", "n_chars", "n_blocks", "template_tokens"],
        )


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, template_tokens) of each page; pages: (page_id, url, html)."""
    hosted = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    found = cut(templates(hosted, least_pages, least_share))
    width = F.length("host") + 8 * F.size("constant") + F.length("content")
    for name in ("slots", "menus"):
        width = width + F.length(F.array_join(name, ",")) + 16
    total = found.agg(F.sum(width)).first()[0] or 0
    joined = hosted.join(F.broadcast(found) if total <= broadcast_bytes else found, "host", "left")
    return joined.select("page_id", "url", "html", *TEMPLATE).mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long, n_blocks long, template_tokens long"
    )


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
