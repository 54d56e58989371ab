"""HTML extraction with removal of site templates.

A page is read once, tag by tag, into blocks of text and element subtrees. Subtrees are hashed by their tags
and text; Spark counts, for each host and for each first folder of its paths, on how many different pages a
hash occurs, and a subtree found on many of them is template: what it holds is deleted. What never is main text goes by
its element or its name (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
comments). A page's main element (article, else main) is its text if it has one. Inside it only a small subtree
under an element with a class, an id or a role counts as template, and only if it holds no prose (paragraphs,
headings, quotations, tables, code, or lines that read like sentences), so passages that a site repeats in its
articles stay.

Counting is one aggregation over (host, folder, hash, page) and one of its counts by host, so a large host is spread
over all tasks. All subtrees are counted, those of menus and footers too; what the element and name rules drop anyway
is dropped without a join, so `n_template` has only the blocks that the count alone removes, and template_report()
says how many subtrees it finds. PAGES and SHARE are parameters: a host with fewer than PAGES pages has no evidence
of a template, and there the rules alone decide.

Cases: null or empty html gives an empty text; unclosed and crossing tags close as browsers close them; an
unclosed comment, script, style or textarea ends the page, an unclosed svg, iframe, noscript, template or title
ends with the element around it; a self-closed svg or iframe is empty; pages of any length are taken whole; equal pages count once
in a folder as evidence of a template; elements nested deeper than DEPTH are siblings; a tag whose quotes do not
pair up ends at the next >, and so do the tags after it; repeated rows each get a row; a null url is a host of its own; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutline.llm.common import discard, materialise, scratch

#: A subtree is template on at least this many different pages of a host or of a folder of it, and this share of them.
PAGES, SHARE = 3, 0.1
#: Inside main elements: the most characters of a template, these elements are prose, and so are lines of over so many words.
SMALL, WORDS = 200, 12
#: Elements nested deeper than this are siblings, as in browsers.
DEPTH = 512
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table figcaption".split())
_SENTENCE = re.compile(r"(?:\S+\s+){3}.*[.!?…][\"'”’»)]*\Z", re.S)

#: A tag after the attribute states of the HTML standard: a quoted value may hold > and the other quote, an unquoted one quotes.
_TAG = re.compile(r"<(/?)([a-z][^\s/>]*+)((?:[\s/]++|=?[^\s/>=]++(?:\s*+=(?:\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+))?+)?+|=)*+)>", re.I)
#: A tag of a page whose quotes do not pair up.
_LOOSE = re.compile(r"<(/?)([a-z][^\s/>]*+)([^>]*+)>", re.I)
_ATTRIBUTE = re.compile(r"(=?[^\s/>=]++)(?:\s*+=(?:\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+)))?+)?+")
_RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I) for tag in ("script", "style", "textarea")}
_UNQUOTED_END = re.compile(r"=\s*[^\s\"'>][^\s>]*/\Z").search
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements in lines of text that never are text. What is left open ends with the element around it, an svg also where a block begins.
_MUTED = frozenset("svg math iframe noscript template title".split())
_BREAKS = frozenset("blockquote center dd div dl dt h1 h2 h3 h4 h5 h6 hr li ol p pre table ul article main section".split())
_INLINE = _MUTED | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
_DROPPED = frozenset("head nav footer aside form button select option object audio video canvas dialog menu map applet".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_NAMES = frozenset(
    "nav navbar navigation menu menubar footer sidebar aside ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner notice notices cookie cookies consent gdpr popup modal newsletter subscribe signup share sharing social related recommended breadcrumb breadcrumbs toolbar pagination pager widget masthead login disclaimer alert".split()
)
#: As a class of its own these say so beside any other name.
_ALWAYS = frozenset("related recommended share sharing newsletter".split())
_COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
_MAIN_NAMES = frozenset("content main article post entry body page story text".split())
_CLOSES = {"li": ("li", ("ul", "ol")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}


class _Node:
    __slots__ = ("tag", "drop", "kind", "parts", "named", "size", "prose", "hash")

    def __init__(self, tag: str, drop: str, kind: int, named: bool = False) -> None:
        self.tag, self.drop, self.kind, self.parts = tag, drop, kind, [tag]
        self.named, self.size, self.prose, self.hash = named, 0, tag in _PROSE, None


def _furniture(value: str) -> bool:
    """Whether class names or an id say so: a compound by its last word (post-share), if it isn't about a neighbour (with-sidebar)."""
    words = set(re.split(r"[^a-z0-9]+", value))
    if words & _NAMES and not words & _MAIN_NAMES or _ALWAYS & set(value.split()):
        return True
    for name in value.split():
        parts = [x for x in re.split(r"[^a-z0-9]+", name) if x]
        if len(parts) > 1 and parts[-1] in _NAMES and not {"with", "has", "no", "without"} & set(parts):
            return True
    return False


def _dropped(tag: str, attrs: str, in_main: bool) -> tuple[str, bool]:
    """(why an element is no main text: 'rest', 'comments' or '', whether it is a main element by role)."""
    why = "rest" if tag in _DROPPED or tag == "header" and not in_main else ""
    role_main = False
    if attrs and not attrs.isspace():
        for m in _ATTRIBUTE.finditer(attrs):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id"):
                if tag in ("html", "body", "main") or name == "id" and tag in _HEADINGS:  # a heading's id repeats its words
                    continue
                words = set(re.split(r"[^a-z0-9]+", value))
                if words & _COMMENTS:
                    why = "comments"
                elif tag != "article" and _furniture(value):
                    why = why or "rest"
                elif "header" in words and not in_main and not words & _MAIN_NAMES:
                    why = why or "rest"
            elif name == "role":
                role_main = role_main or value == "main"
                if value in _ROLES and tag not in ("html", "body", "main", "article"):
                    why = why or "rest"
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                if tag not in ("html", "body"):
                    why = why or "rest"
    return why, role_main


def _tokens(page: str):
    """(start, end, whether it is an end tag, tag or None for what holds no text, attributes) in page order, in linear time."""
    at, last, match, strict = 0, page.rfind(">"), _TAG.match, True
    while True:
        start = page.find("<", at)
        if start < 0:
            return
        if page.startswith("<!--", start):
            end = page.find("-->", start + 2)
            if end < 0:
                yield start, len(page), False, None, ""
                return
            at = end + 3
            yield start, at, False, None, ""
            continue
        if start > last:
            at = start + 1
            continue
        m = match(page, start)
        if m is None and strict and _LOOSE.match(page, start):
            match, strict = _LOOSE.match, False  # the standard would drop the rest of the page
            m = match(page, start)
        if m is None:
            at = start + 1
            if page[at : at + 1] in ("!", "?", "/"):  # a declaration
                at = page.find(">", at) + 1
                yield start, at, False, None, ""
            continue
        at, tag, attrs = m.end(), m[2].lower(), m[3]
        raw = None if m[1] else _RAW.get(tag)
        if raw:
            ended = raw.search(page, at)
            at = ended.end() if ended else len(page)
            yield start, at, False, None, ""
        elif not m[1] and tag in ("svg", "math", "iframe") and attrs.endswith("/") and not _UNQUOTED_END(attrs):
            yield start, at, False, None, ""
        else:
            yield start, at, bool(m[1]), tag, attrs


def parse(page: str) -> tuple[int, list[tuple[int, str, list]], list[int]]:
    """(kind, blocks, hashes): the best main element (2 article, 1 main, 0 none), the blocks that are not dropped as
    (kind, text, open subtrees), and the hashes of the subtrees that can be template."""
    import xxhash

    stack = [_Node("", "", 0)]
    blocks: list[tuple[int, str, list]] = []
    hashes: list[int] = []
    best, buffer = 0, []
    opened: Counter[str] = Counter()

    def push(node: _Node) -> None:
        if len(stack) > DEPTH:
            pop()
        stack.append(node)
        opened[node.tag] += 1

    def flush() -> None:
        if not buffer:
            return
        text = "".join(buffer)
        buffer.clear()
        if "&" in text:
            text = entities.unescape(text)
        text = " ".join(text.split())
        if not text:
            return
        top = stack[-1]
        top.parts.append(text)
        top.size += len(text)
        top.prose = top.prose or bool(_SENTENCE.match(text)) or len(text.split()) > WORDS
        if not top.drop:
            blocks.append((top.kind, text, stack[1:]))

    def pop() -> None:
        node = stack.pop()
        opened[node.tag] -= 1
        up = stack[-1]
        if len(node.parts) < 2 or node.tag in ("html", "body") or node.kind != up.kind:
            return  # a main element is no part of what is around it
        h = xxhash.xxh3_64_intdigest("\x00".join(node.parts), seed=min(node.kind, 1))
        if not node.kind or node.named and not node.prose and node.size <= SMALL:
            node.hash = h
            hashes.append(h)
        up.parts.append(f"{h:x}")
        up.size += node.size
        up.prose = up.prose or node.prose

    muted, depth, below = "", 0, 0  # an inline element that is dropped, how often it is open, and the height of the stack
    at = 0
    for start, end, closing, tag, attrs in _tokens(page):
        if start > at and not muted:
            buffer.append(page[at:start])
        at = end
        if tag is None:
            continue
        if tag in _VOID:
            if tag == "br":
                buffer.append(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in _INLINE:
            if muted:
                depth += (tag == muted) * (-1 if closing else 1)
                muted = muted if depth else ""
            elif not closing and (tag in _MUTED or attrs and _dropped(tag, attrs, True)[0]):
                muted, depth, below = tag, 1, len(stack)
            continue
        if muted in ("svg", "math") and not opened[tag if closing else "foreignobject"]:
            if closing or tag != "foreignobject" and tag not in _BREAKS:
                continue  # a shape
            if tag != "foreignobject":
                muted, depth, below = "", 0, 0
        if closing:
            flush()
            if opened[tag]:
                while stack[-1].tag != tag:
                    pop()
                pop()
                if len(stack) < below:
                    muted, depth, below = "", 0, 0
            continue
        flush()
        if stack[-1].tag == "p" and tag != "foreignobject":
            pop()
        if tag in _CLOSES:
            closed, scope = _CLOSES[tag]
            closed = [x for x in closed.split() if opened[x]]
            for k in range(len(stack) - 1, 0, -1) if closed else ():
                if stack[k].tag in scope:
                    break
                if stack[k].tag in closed:
                    while len(stack) > k:
                        pop()
                    break
        top = stack[-1]
        why, role_main = _dropped(tag, attrs, top.kind > 0)
        kind = top.kind
        if tag == "article" or tag == "main" or role_main:
            if not why and top.drop != "comments":
                kind = max(kind, 2 if tag == "article" else 1)
                best = max(best, kind)
                push(_Node(tag, "", kind))
                continue
        push(_Node(tag, top.drop or why, kind, bool(re.search(r"\b(?:class|id|role)\s*=", attrs, re.I))))
    if at < len(page):
        rest = page[at:]
        cut = re.search(r"<[a-zA-Z/!]", rest[rest.rfind(">") + 1 :])  # a tag that the page ends in
        if not muted:
            buffer.append(rest[: rest.rfind(">") + 1 + cut.start()] if cut else rest)
    flush()
    while len(stack) > 1:
        pop()
    return best, [(kind, text, [n.hash for n in nodes if n.hash is not None]) for kind, text, nodes in blocks], hashes


BLOCKS = "page_id bigint, url string, host string, sig bigint, kind int, blocks array<struct<text: string, at: array<bigint>>>, hashes array<bigint>"


def _read(batches):
    import pyarrow as pa
    import xxhash

    kind_of = pa.list_(pa.struct([("text", pa.string()), ("at", pa.list_(pa.int64()))]))
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    for batch in batches:
        for k in range(0, batch.num_rows, 200):
            part = batch.slice(k, 200)
            out: list[list] = [[], [], [], []]
            for page in part.column(3).to_pylist():
                best, blocks, hashes = parse(page or "")
                out[0].append(signed(xxhash.xxh3_64_intdigest(page or "")))
                out[1].append(best)
                out[2].append([{"text": text, "at": [signed(h) for h in at]} for kind, text, at in blocks if kind >= best])
                out[3].append(sorted({signed(h) for h in hashes}))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(3)), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], kind_of), pa.array(out[3], pa.list_(pa.int64()))], names=["page_id", "url", "host", "sig", "kind", "blocks", "hashes"])


def _host(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def _folder(url: str = "url"):
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]+)/", 1), F.lit(""))


def templates(read: DataFrame, pages_min: int, share: float, run: str) -> DataFrame:
    """(host, folder, h): the subtrees that are template there, by the folder's pages or by all of the host."""
    seen = read.select("host", "folder", "sig", F.explode("hashes").alias("h")).groupBy("host", "folder", "h").agg(F.countDistinct("sig").alias("n"))
    seen = materialise(seen, "seen", run)
    size = materialise(read.groupBy("host", "folder").agg(F.countDistinct("sig").alias("pages")), "size", run)
    hosts = size.groupBy("host").agg(F.sum("pages").alias("pages"))
    often = F.col("n") >= F.greatest(F.lit(pages_min), share * F.col("pages"))
    by_folder = seen.where(F.col("n") >= pages_min).join(size, ["host", "folder"]).where(often).select("host", "folder", "h")
    by_host = seen.groupBy("host", "h").agg(F.sum("n").alias("n")).where(F.col("n") >= pages_min).join(hosts, "host").where(often).select("host", "h")
    by_host = seen.join(materialise(by_host, "by_host", run), ["host", "h"], "left_semi").select("host", "folder", "h")
    return materialise(by_folder.unionByName(by_host).distinct(), "template", run)


def _read_pages(pages: DataFrame, run: str) -> DataFrame:
    read = pages.select(F.col("page_id").cast("long"), "url", _host().alias("host"), "html").mapInArrow(_read, BLOCKS)
    return materialise(read.withColumn("folder", _folder()).withColumn("row", F.monotonically_increasing_id()), "pages", run)


def template_report(pages: DataFrame, pages_min: int = PAGES, share: float = SHARE) -> DataFrame:
    """One row: pages, subtrees (occurrences on pages), template (those that go), and pages with any that go."""
    run = scratch(pages.sparkSession, "template-report")
    read = _read_pages(pages, run)
    at = read.select("row", "host", "folder", F.explode("hashes").alias("h"))
    gone = templates(read, pages_min, share, run).withColumn("gone", F.lit(1))
    found = at.join(gone, ["host", "folder", "h"], "left").agg(F.count("*").alias("subtrees"), F.count("gone").alias("template"), F.countDistinct(F.when(F.col("gone") == 1, F.col("row"))).alias("pages_with_template"))
    out = materialise(read.agg(F.count("*").alias("pages")).crossJoin(found), "report")  # a row by a row
    discard(pages.sparkSession, run)
    return out


def extract(pages: DataFrame, pages_min: int = PAGES, share: float = SHARE) -> DataFrame:
    """page_id, url, text, n_chars, n_template (blocks that went as template): a row for each row of pages (page_id, url, html)."""
    spark = pages.sparkSession
    run, kept = scratch(spark, "templates"), scratch(spark, "pages")
    read = _read_pages(pages, kept)
    template = templates(read, pages_min, share, run)

    # only pages with blocks that a template can hold go through the join
    held = F.exists("blocks", lambda b: F.size(b["at"]) > 0)
    loose = read.where(held).select("row", "host", "folder", F.posexplode("blocks").alias("k", "block")).select("row", "host", "folder", "k", F.explode("block.at").alias("h"))
    gone = loose.join(template, ["host", "folder", "h"], "left_semi").groupBy("row").agg(F.collect_set("k").alias("gone"))
    gone = materialise(gone, "gone")
    discard(spark, run)
    left = read.where(held).select("row", "page_id", "url", "blocks").join(gone, "row", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    rest = F.filter("blocks", lambda b, k: ~F.array_contains("gone", k))

    def rows(df: DataFrame, blocks, n_gone) -> DataFrame:
        text = F.array_join(F.transform(blocks, lambda b: b["text"]), "\n\n")
        return df.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"), n_gone.cast("long").alias("n_template"))

    return rows(read.where(~held), F.col("blocks"), F.lit(0)).unionByName(rows(left, rest, F.size("gone")))


QUERIES = {"op8_page_text": lambda spark, sf_dir: extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))}
ORACLES: dict[str, str] = {}
