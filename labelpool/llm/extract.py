"""HTML extraction by equivalence-class template deduction.

A page's elements and texts are tokens. An element is told apart by its role, the path
of open elements that it stands in; a text is all that stands between two block tags, and
told apart by its words and role. A token's occurrence vector over the different pages of
its host says how often it occurs in each. Tokens of a host with equal vectors form an
equivalence class. A box is a block element with a class. The template is made of:

* the elements that occur once on every page. The article elements among them (else the
  main elements, else the body) are the slots that the text is read from;
* constant boxes: at most once a page, and all their text the same on at least half of the
  host's pages, two at least, and less than half of their text. A paragraph of an article
  stays, however many pages repeat it;
* record lists: a box that is repeated within its parent, and whose vector some element
  directly inside it shares. Such a class is nested validly if nothing but the list ends
  its parent, on all pages; one that holds a time, a cite or an author's name counts
  wherever it stands. Classes with half of a host's text are the text itself. A list goes
  with its parent if that holds little more. Reader comments are such lists;
* on hosts without article and main elements, boxes with under SMALL of the text that
  stand on all pages on the same side of the main box and the first heading before it.
  The main box is the innermost with half of a page's text. Boxes whose side differs from
  page to page are out of order and stay;
* texts outside articles that all of at least CONSTANT_TEXTS pages have.

What these leave of the slots is read, without the elements that HTML sets apart from the
text, and without elements one of whose names is, as a whole, on the list below. A host of
one page shows no template; there, outside articles, any part of a name counts.

Vectors are compared by a sum of counts times the pages' hashes, so that the pages
of a host are added up before any shuffle by host, however many there are.

Defined results: a null or empty html gives an empty text; a null url belongs to
the empty host; a page on which its host's slots are missing is read by the most
general rule (its own article or main element, else its body); a page that holds
nothing but template keeps it; repeated rows count as one page of the
template and each get their text. Extra columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from labelpool.llm.batches import bounded_batches, checkpointed
from labelpool.llm.url_filter import host_of

SUPPORT = 0.5            # share of a host's pages that a template class must occur on
CONSTANT_TEXTS = 8       # different pages from which a constant text outside articles goes
SMALL = 0.1              # share of a host's text under which a box beside the main box goes
BROADCAST_ENTRIES = 400_000   # hosts, and 64-bit keys of their templates, that are broadcast at most

# fixed values: HTML's element kinds
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|[^<]+|<", re.S)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg math select button object canvas audio video".split())
_RAW_TEXT = frozenset("script style textarea title iframe".split())
_INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_NOT_TEXT = frozenset("head nav header footer aside form menu dialog label input".split()) | _RAW
_CLASS = re.compile(r"""(?:^|\s)class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NOT_TEXT_NAMES = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|adslot|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|header|footer|side-?bar|cookie\w*|consent|notices?|"
    r"newsletter|subscribe|popup|modal|comments?|replies|respond|disqus|related|recommend\w*|share|sharing|social|toolbar|pagination|pager|skip)(?:[^a-z]|$)")
_WHOLE_NAME = re.compile(_NOT_TEXT_NAMES.pattern.replace("(?:^|[^a-z])", "^", 1).removesuffix("(?:[^a-z]|$)") + "$")
_AUTHOR = re.compile(r"\b(?:author|user(?:name)?|by(?:line)?|date|time(?:stamp)?|avatar|reply)\b")
_BOXES = frozenset("div section ul ol dl table li article blockquote p".split())
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)


def _dropped(tag: str, attributes: str, few: bool, general: bool) -> bool:
    """Whether an element holds no article text, by its kind and its names."""
    if tag in _NOT_TEXT:
        return True
    if tag in ("article", "main", "body", "html") or not attributes:
        return False
    few = few and not general
    names = [re.sub(r"([a-z])([A-Z])", r"\1-\2", m).lower() for m in _NAMES.findall(attributes)]
    return any(_NOT_TEXT_NAMES.search(m) if few else any(map(_WHOLE_NAME.match, m.strip("\"'").split())) for m in names)


def _class_of(attributes: str) -> str:
    """All class names of an element."""
    m = _CLASS.search(attributes) if attributes else None
    return (m[1] or m[2] or m[3] or "").strip() if m else ""


def _key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


class Element:
    """An open element: ``role`` is its path in 64 bits; ``dropped``, ``general`` and
    ``inside`` say whether it or one around it holds no article text, is an article or
    main element, is a slot; ``block`` is the role of the innermost block element,
    ``box`` the innermost box around it."""

    __slots__ = ("tag", "names", "role", "dropped", "general", "inside", "block", "box", "parent", "start", "ends")

    def __init__(self, tag, names, parent, dropped, general, inside):
        self.tag, self.names, self.parent = tag, names, parent
        self.role = _key(f"{parent.role if parent else 0}/{tag}.{names.split()[0] if names else ''}")
        self.dropped = dropped or (parent is not None and parent.dropped)
        self.general = general or (parent is not None and parent.general)
        self.inside = inside or (parent is not None and parent.inside)
        self.block = parent.block if tag in _INLINE and parent else self.role
        self.box = (parent if parent.is_box() else parent.box) if parent else None
        self.start, self.ends = None, None

    def is_box(self) -> bool:
        return self.tag in _BOXES and bool(self.names or self.tag == "article")


def walk(html: str, few: bool, slots=frozenset(), drop=frozenset()):
    """Yield ("open" or "close", element, None), ("text", the element around it or None,
    text) and ("break", None, None) at block tags. An element is closed where HTML
    implies it, and at the end."""
    stack: list[Element] = []
    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.match(html, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                yield "text", stack[-1] if stack else None, m[0]
            elif m[0].startswith("<![CDATA["):
                yield "text", stack[-1] if stack else None, m[0][9:].removesuffix("]]>")
            continue
        tag = tag.lower()
        if tag not in _INLINE:
            yield "break", None, None
        keep = len(stack)      # elements beyond it are closed
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    keep = k
                    break
                if stack[k].tag in ("article", "main", "body", "td", "section", "div") and tag in _INLINE | {"p"}:
                    break
            while len(stack) > keep:
                yield "close", stack.pop(), None
            continue
        if tag in _CLOSES_P:
            for k in range(keep - 1, -1, -1):
                if stack[k].tag == "p":
                    keep = k
                    break
                if stack[k].tag not in _INLINE:
                    break
        for k in range(keep - 1, -1, -1):
            if stack[k].tag in _SIBLINGS.get(tag, ()):
                keep = k
                break
            if stack[k].tag in ("ul", "ol", "dl", "table", "tbody", "thead", "select") or tag not in _SIBLINGS:
                break
        if tag == "body":  # the head ends here, closed or not
            keep = next((k for k, x in enumerate(stack[:keep]) if x.tag == "head"), keep)
        while len(stack) > keep:
            yield "close", stack.pop(), None
        if tag in _VOID:
            continue
        if tag in _RAW_TEXT:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
            at = end.end() if end else n
            continue
        parent = stack[-1] if stack else None
        e = Element(tag, _class_of(m[3]), parent, _dropped(tag, m[3], few, parent is not None and parent.general), tag in ("article", "main"), False)
        if e.role in drop:
            e.dropped = True
        if e.role in slots:
            e.inside = True
        stack.append(e)
        yield "open", e, None
    yield "break", None, None
    while stack:
        yield "close", stack.pop(), None


def blocks(events):
    """Pass on the events but texts and breaks, and yield ("block", element, text) for the
    text between any two block tags, before what follows it."""
    at, parts = None, []
    for kind, e, text in events:
        if kind == "text":
            if not parts:
                at = e
            parts.append(" " if e is not None and e.dropped else text)
            continue
        if parts and (kind == "break" or e.dropped or e.tag not in _INLINE):
            yield "block", at, "".join(parts)
            parts = []
        if kind != "break":
            yield kind, e, text
    if parts:
        yield "block", at, "".join(parts)


def text_key(element: Element | None, text: str) -> int:
    """A text token: its role and words in 64 bits."""
    return _key(f"{element.block if element else 0}\0{' '.join(text.split())}")


_BASE, _MOD = 0x1F3D5B79A4C6E823, (1 << 61) - 1    # of the hash of a box's texts, a polynomial


def page_tokens(html: str) -> list[tuple]:
    """The page's tokens, one row each:
    (kind, key, tag, n, chars, all, box, hash, side, tail, strong, up, up_chars, general).

    Of an element's role: how often it occurs and how much text it has of ``all`` on the
    page, the role of the box around it, a hash of its text, its side of the main box, whether
    its parents end with it, whether its name is that of a record's author or date, its
    parent's role and text if that is a box, whether it lies in an article."""
    n, chars, hashes, tail, up_chars = Counter(), Counter(), {}, {}, Counter()
    known, texts, spans = {}, Counter(), []
    total = at = value = 0       # characters, texts and the hash of the texts so far
    heading = None
    for kind, e, text in blocks(walk(html, False)):
        if kind == "block":
            if words := " ".join(text.split()):
                total, at, value = total + len(words), at + 1, (value * _BASE + _key(words)) % _MOD
                if e is None or not e.general:
                    texts[text_key(e, words)] += 1
                if heading is None and e is not None and (e.tag == "h1" or e.parent is not None and e.parent.tag == "h1"):
                    heading = at
        elif e.dropped or e.tag in _INLINE and not (e.names or e.tag in ("time", "cite")):
            continue
        elif kind == "open":
            e.start = total, at, value
            n[e.role] += 1
            known.setdefault(e.role, e)
        else:
            had, since, before = e.start
            chars[e.role] += total - had
            for role, end in (e.ends or {}).items():
                tail[role] = tail.get(role, True) and end == total
                up_chars[role] += total - had
            if e.is_box():
                hashes[e.role] = (value - before * pow(_BASE, at - since, _MOD)) % _MOD
                spans.append((e, since, at, total - had))
                if e.parent is not None and e.parent.start is not None:
                    if e.parent.ends is None:
                        e.parent.ends = {}
                    e.parent.ends[e.role] = total
    sides = {}
    halves = [x for x in spans if 2 * x[3] >= total > 0]
    if halves:
        _, lo, hi, _ = halves[0]      # boxes close from within, so the first is an innermost one
        first = min(lo, heading - 1) if heading is not None else lo
        for e, a, b, _ in spans:
            side = 0 if a <= lo and hi <= b or lo <= a and b <= hi else -1 if b <= first else 1 if a >= hi else 0
            sides[e.role] = side if sides.get(e.role, side) == side else 0
    rows = [("page", 0, "", 1, 0, total, 0, 0, 0, 0, 0, 0, 0, 0)]
    for role, e in known.items():
        up = e.parent if e.parent is not None and e.parent.is_box() and e.parent.tag not in ("article", "main") else None
        rows.append(("box" if e.is_box() else "tag", role, e.tag, n[role], chars[role], total, e.box.role if e.box else 0, hashes.get(role, 0),
                     sides.get(role, 0), int(tail.get(role, False)), int(e.tag in ("time", "cite") or bool(_AUTHOR.search(e.names.lower()))),
                     up.role if up else 0, up_chars[role], int(e.parent is not None and e.parent.general)))
    return rows + [("text", key, "", k, 0, total, 0, 0, 0, 0, 0, 0, 0, 0) for key, k in texts.items()]


def slot_text(html: str, slots: list[int] | None = None, constant: list[int] | None = None, drop: list[int] | None = None, few: bool = True) -> str:
    """The kept text of a page in the elements with the roles ``slots``; without any,
    or if the page lacks them, in its article or main elements, else its body. Texts
    that are ``constant`` and elements to ``drop`` go, unless the page has no other."""
    if not html:
        return ""
    constant = frozenset(constant or ())
    inside, general, whole = [], [], []   # texts in the slots, in an article, in all
    in_slot = in_general = False
    for kind, e, text in blocks(walk(html, few, frozenset(slots or ()), frozenset(drop or ()))):
        if kind == "open":
            in_slot, in_general = in_slot or e.inside, in_general or e.general and not e.dropped
        elif kind == "block":
            if constant and not (e is not None and e.general) and text_key(e, text) in constant:
                continue
            whole.append(text)
            if e is not None and e.general:
                general.append(text)
            if e is not None and e.inside:
                inside.append(text)
    found = inside if in_slot else general if in_general else whole
    text = " ".join(unescape(" ".join(found)).split())
    return slot_text(html, slots, few=few) if not text and (constant or drop) else text


_ROW = "kind string, key long, tag string, n long, chars long, all long, box long, hash long, side int, tail int, strong int, up long, up_chars long, general int"
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}


def host_templates(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, few, slots, constant, drop): whether a host has one page, the roles of the main
    text's elements in its template, its constant texts, and the roles of elements to drop."""
    kinds = [("host", pa.string()), ("page", pa.int64()), *((c, _ARROW[t]) for c, t in map(str.split, _ROW.split(", ")))]

    def tokens_of(batches):
        for b in batches:
            out = [(host, page, *row) for host, page, html in zip(*(b.column(c).to_pylist() for c in ("host", "page", "html"))) for row in page_tokens(html or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(kinds)], names=[c for c, _ in kinds])

    rows = pages.select(F.coalesce(host_of(F.col(url_col)), F.lit("")).alias("host"), F.xxhash64(html_col).alias("page"), F.col(html_col).alias("html"))
    figures = [c.split()[0] for c in _ROW.split(", ")[2:]]
    # rows of one page are alike: copies of it count once
    found = rows.mapInArrow(tokens_of, f"host string, page long, {_ROW}").groupBy("host", "page", "kind", "key").agg(*(F.max(c).alias(c) for c in figures))
    # sums of 31-bit hashes times counts stay exact in a decimal
    vector = F.sum((F.col("n") * F.shiftrightunsigned("page", 33)).cast("decimal(38,0)"))
    least, sums, most = ("hash", "side", "tail"), ("n", "chars", "all", "up_chars"), ("tag", "box", "strong", "up", "general", "hash", "side")
    tokens = checkpointed(found.groupBy("host", "kind", "key").agg(
        vector.alias("vector"), F.count("*").alias("pages"), F.max("n").alias("n_most"), *(F.min(c).alias(f"{c}_least") for c in least),
        *(F.sum(c).alias(c) for c in sums), *(F.max(c).alias(c) for c in most))
        .filter((F.col("kind") == "page") | (F.col("pages") >= F.when(F.col("kind") == "text", CONSTANT_TEXTS).otherwise(2))))
    sizes = tokens.filter("kind = 'page'").select("host", F.col("pages").alias("all_pages"), F.col("all").alias("host_chars"))
    known = tokens.join(sizes, "host").filter("all_pages > 1 and kind <> 'page'")
    constant = known.filter("kind = 'text' and pages = all_pages").groupBy("host").agg(F.collect_list("key").alias("constant"))
    # the article elements that occur once on every page, else the main elements
    slots = known.filter("tag in ('article', 'main') and pages = all_pages and n = pages and general = 0 and chars > 0") \
        .groupBy("host").agg(F.max(F.when(F.col("tag") == "article", 2).otherwise(1)).alias("best"), F.collect_list(F.struct("tag", "key")).alias("all")) \
        .select("host", F.expr("transform(filter(all, x -> x.tag = if(best = 2, 'article', 'main')), x -> x.key)").alias("slots"))
    boxes = known.filter("kind = 'box' and chars > 0")
    in_article = (F.col("general") == 1) & ~F.col("tag").isin("div", "section")
    same = boxes.filter((F.col("n_most") == 1) & (F.col("hash") == F.col("hash_least")) & ~F.col("tag").isin("article") & ~in_article
                        & (F.col("pages") >= SUPPORT * F.col("all_pages")) & (2 * F.col("chars") < F.col("all"))).select("host", "key")
    beside = boxes.join(slots.select("host"), "host", "left_anti").filter(
        (F.col("general") == 0) & (F.col("side") == F.col("side_least")) & (F.col("side") != 0) & (F.col("pages") >= SUPPORT * F.col("all_pages"))
        & ~F.col("tag").isin("p", "blockquote") & (F.col("chars") < SMALL * F.col("all"))).select("host", "key")
    members = known.filter("kind in ('box', 'tag') and box <> 0").groupBy("host", "vector", F.col("box").alias("key")).agg(F.max("strong").alias("by"))
    lists = boxes.filter((F.col("n") > F.col("pages")) & ~F.col("tag").isin("p", "blockquote", "table", "ul", "ol", "dl") & (2 * F.col("chars") < F.col("all"))) \
        .join(members, ["host", "vector", "key"]).filter("tail_least = 1 or by = 1")
    around = lists.filter("up <> 0 and 2 * chars >= up_chars and 2 * up_chars < all").select("host", F.col("up").alias("key"))
    drop = same.unionByName(beside).unionByName(lists.select("host", "key")).unionByName(around).groupBy("host").agg(F.collect_set("key").alias("drop"))
    return sizes.join(slots, "host", "left").join(constant, "host", "left").join(drop, "host", "left") \
        .select("host", (F.col("all_pages") < 2).alias("few"), "slots", "constant", "drop")


def extract_text(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text of each page."""
    bounded_batches(pages.sparkSession)
    templates = checkpointed(host_templates(pages, url_col, html_col).toDF("_host", "_few", "_slots", "_constant", "_drop"))
    entries = F.lit(1) + F.greatest(F.size("_slots"), F.lit(0)) + F.greatest(F.size("_constant"), F.lit(0)) + F.greatest(F.size("_drop"), F.lit(0))
    if (templates.agg(F.sum(entries)).first()[0] or 0) <= BROADCAST_ENTRIES:
        templates = F.broadcast(templates)
    rows = pages.withColumn("_at", F.coalesce(host_of(F.col(url_col)), F.lit(""))).join(templates, F.col("_at") == F.col("_host"), "left").drop("_at", "_host")
    names = pages.columns

    def texts(batches):
        for b in batches:
            out = [slot_text(h or "", *t) for h, *t in zip(*(b.column(c).to_pylist() for c in (html_col, "_slots", "_constant", "_drop", "_few")))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, pa.string())], names=[*names, "_text"])

    schema = pages.withColumn("_text", F.lit("")).schema
    return rows.mapInArrow(texts, schema)


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every page."""
    return extract_text(pages.select("page_id", "url", "html")).select(
        "page_id", "url", F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))
