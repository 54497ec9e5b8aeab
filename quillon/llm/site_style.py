"""Main text of web pages by a site style tree.

The DOMs of all pages of a host are merged: nodes with the same path of block
elements (tag and first class or id) are one node of the host's tree. A node
has two features on every page: its presentation (the sequence of its child
elements and texts, unless it is all text) and its content (the text directly in it). Over the m
pages that have the node, a feature's importance is its entropy divided by
log m: 0 where all pages show the same, 1 where all differ. Two measures of a
branch follow from it.

* Its importance is the mean over its nodes, discounted by ``GAMMA`` per level.
  Branches whose importance is below ``LEAST`` are removed from every page of
  the host: a menu of fixed shape goes even if its links change. A text of more
  than ``MENU_WORDS`` words goes only if its node's content alone has so little
  importance, so a fixed frame around new prose takes nothing along. Inside
  ``article`` and ``main``, where lists and tables of one shape hold different
  texts, a branch's importance must be below ``LEAST_INSIDE`` on
  ``ARTICLE_PAGES`` pages or more, so that a site of copies keeps its text.
* Its information is the number of its words, each times the importance of its
  text among the node's (1 for a text that one page has, 0 for one that all
  have). The main branch is the deepest one that holds ``MAIN`` of its host's
  information and isn't mere text. Branches beside it that hold less than
  ``ASIDE`` of the information are removed, too: adverts, footers and teasers,
  whose texts differ from page to page. Headings whose texts differ stay, and so
  does what lies in ``article`` or ``main``.

Hosts of fewer than ``LEAST_PAGES`` pages have no tree to speak of. There the
element or class, id and role names tell: a name counts if all its parts are
such names (``main-nav``, but not ``has-sidebar`` or ``article-header``), unless
another name of the element is one of content, never on html, body, main and
article, and inside the last two only if no part of an article is called so.
A form or a named element that holds more than half of a page's words is none of
these, but a page in a form. Readers' comments, which look like articles to any
tree, are told by name everywhere.

Feature counts are aggregated by host, node and feature, so a hot host is
spread over many tasks; what returns to the pages of a host is the list of its
low branches, whose length depends on its templates and not on its pages.

Defined results: a null or empty html gives an empty text; a page without a
usable host is judged by names only; unclosed elements end with their parent or
the page, and one whose text would be skipped is then markup only; ``<br>`` is
white space; a lone ``<`` is text; repeated pages count as often as they occur;
an empty table gives no rows. Input columns may have any names; one that is
called ``main_text`` is replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import positional, table, with_fields

GAMMA = 0.9
LEAST = 0.3
LEAST_INSIDE = 0.05
MENU_WORDS = 5
LEAST_PAGES = 5
ARTICLE_PAGES = 40
MAIN = 0.5
ASIDE = 0.15
BROADCAST_BYTES = 8 << 20

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas title textarea select option button head".split())
PLAIN_TEXT = frozenset("script style title textarea iframe noscript".split())
#: what a head may hold; any other element ends it, with or without its end tag
IN_HEAD = frozenset("html head title base link meta style script noscript template".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
BOILERPLATE_NAMES = frozenset("ad ads adv advert adverts advertisement sponsor sponsored promo banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar side menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments respond reply replies disqus share sharing social related recommended recommendations newsletter subscribe signup login search widget pagination pager skip toolbar".split())
NEUTRAL_NAMES = frozenset("area bar bottom box container content global inner item items left link links list main primary right secondary section site slot text top unit wrap wrapper".split())
CONTENT_NAMES = frozenset("article body content entry main post story text".split())
#: names that tell inside an article, too
INSIDE_NAMES = frozenset("ad ads adv advert adverts advertisement sponsor sponsored promo banner cookie cookies consent gdpr popup modal overlay navbar breadcrumb breadcrumbs comment comments disqus newsletter subscribe signup login share sharing pagination pager".split())
#: elements that are boilerplate whatever they hold
HARD_TAGS = frozenset("nav footer aside menu header".split())
COMMENT_NAMES = frozenset("comment comments disqus respond reply replies".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
#: elements that a new one of the key's kind closes
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "p"}}
CLOSES |= {t: {"p"} for t in BLOCKS - CLOSES.keys() - {"html", "body", "hr"}}
#: elements that names never mark
SPARED = frozenset("html body main article".split())
#: skipped elements that hold others of their kind
NESTED = frozenset("svg math object template noscript".split())
FENCE = frozenset("html body article main section div ul ol dl table blockquote nav aside footer header form fieldset figure details dialog".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>", re.S)
_NAME = re.compile(r"\b(class|id|role)\s*+(?:=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PART = re.compile(r"[A-Za-z]+")


def _names(attributes: str, inside: bool) -> tuple[str, bool, bool]:
    """(label of an element's class or id, whether its names mark boilerplate, or comments)."""
    label, marked, content, comment = "", False, False, False
    for m in _NAME.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "role":
            marked |= value in BOILERPLATE_ROLES and not inside
            continue
        words = value.split()
        label = label or ("." + words[0].replace("%", "%25").replace("/", "%2f") if words else "")
        for w in words:
            parts = set(_PART.findall(w))
            marked |= bool(parts & (INSIDE_NAMES if inside else BOILERPLATE_NAMES)) and parts <= BOILERPLATE_NAMES | NEUTRAL_NAMES
            comment |= bool(parts & COMMENT_NAMES) and parts <= COMMENT_NAMES | NEUTRAL_NAMES
            content |= bool(parts) and parts <= CONTENT_NAMES
    return label, marked and not content, comment and not content


HARD, COMMENT = -1, -2


def _marks(blocks: list[tuple[str, tuple[int, ...], str]]) -> list[tuple[str, int, str]]:
    """Blocks with what marks them: 0 nothing, 1 an element, 2 readers' comments; an element around more than half of a page's words marks none."""
    words: dict[int, int] = {}
    total = 0
    for _, by, t in blocks:
        n = t.count(" ") + 1
        total += n
        for e in by:
            words[e] = words.get(e, 0) + n
    return [(path, 2 if COMMENT in by else int(any(e == HARD or 2 * words[e] <= total for e in by)), t) for path, by, t in blocks]


def parse(page: str | None) -> tuple[list[tuple[str, int, str]], dict[str, tuple[str, str]]]:
    """Blocks (path, mark, text) in page order; and path -> (child sequence, own text)."""
    page = page or ""
    blocks: list[tuple[str, tuple[int, ...], str]] = []
    style: dict[str, list[str]] = {}
    stack: list[tuple[str, str, tuple[int, ...]]] = [("", "", ())]  # tag, path, elements that mark it
    text: list[str] = []
    skip, depth, opened = "", 0, 0  # the element whose text is skipped, those of its kind within, blocks open in it
    at = 0
    closes: dict[str, int] = {}  # where an element's last end tag is

    def shown(child: str) -> None:
        style.setdefault(stack[-1][1], []).append(child)

    def flush() -> None:
        if text:
            words = html.unescape("".join(text)).split()
            text.clear()
            if words:
                shown("#")
                blocks.append((stack[-1][1], stack[-1][2], " ".join(words)))

    def after(tag: str, start: int) -> int:
        end = re.compile(rf"</{tag}\s*>", re.I).search(page, start)
        return end.end() if end else len(page)

    def ends_later(tag: str) -> bool:
        if tag not in closes:
            closes[tag] = max((m.start() for m in re.finditer(rf"</{tag}\s*>", page, re.I)), default=-1)
        return closes[tag] >= at

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at and not skip:
            text.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        open_ = not closing and not m[3].endswith("/")
        if skip:
            if tag == skip:
                depth += -1 if closing else (open_ and tag in NESTED)
                if depth < 0:
                    skip = ""
                continue
            if open_ and tag in PLAIN_TEXT:
                at = after(tag, at)
                continue
            if skip == "head":
                over = not closing and tag not in IN_HEAD
                if open_ and tag == "template":
                    at = after(tag, at)
            elif tag in BLOCKS and tag not in VOID:
                # a block's end that began outside ends the element; so does any block for an option
                over = skip == "option" or closing and opened == 0
                opened += -1 if closing else 1
            else:
                over = skip == "option" and closing and tag in ("select", "datalist", "optgroup")
            if not over:
                continue
            skip = ""
        if tag in RAW:
            if open_:
                if tag in PLAIN_TEXT:
                    at = after(tag, at)
                elif tag in ("head", "option") or ends_later(tag):
                    skip, depth, opened = tag, 0, 0
            text.append(" ")
            continue
        if tag in VOID or tag in ("td", "th"):
            if tag == "hr":
                flush()
            else:
                text.append(" ")
            if not closing:
                shown(tag)
            continue
        if tag not in BLOCKS:
            if not closing:
                shown(tag)
            continue
        flush()
        if closing:
            level = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if level:
                del stack[level:]
            continue
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in CLOSES.get(tag, ()):
                del stack[i:]
                break
            if stack[i][0] in FENCE:
                break
        inside = any(s[0] in ("article", "main") for s in stack)
        label, marked, comment = _names(m[3], inside)
        child = tag + label
        shown(child)
        path = f"{stack[-1][1]}/{child}"
        style.setdefault(path, [])
        by = stack[-1][2] if tag not in ("article", "main") else tuple(e for e in stack[-1][2] if e == COMMENT)
        if tag not in SPARED:
            if comment:
                by = (*by, COMMENT)
            if tag in HARD_TAGS and not (tag == "header" and inside):
                by = (*by, HARD)
            elif marked or tag in BOILERPLATE_TAGS:
                by = (*by, m.start())
        stack.append((tag, path, by))
    if at < len(page) and not skip:
        text.append(page[at:])
    flush()
    own: dict[str, list[str]] = {}
    for path, _, t in blocks:
        own.setdefault(path, []).append(t)
    return _marks(blocks), {p: (" ".join(c) if set(c) - {"#"} else "", "\n".join(own.get(p, ()))) for p, c in style.items()}


FEATURES = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("kind", T.IntegerType()), T.StructField("feature", T.LongType()), T.StructField("words", T.LongType())])


def _features(batches):
    hashed = lambda s: xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)
    for batch in batches:
        hosts, pages = batch.column(0), batch.column(1)
        for start in range(0, batch.num_rows, 200):
            rows: list[tuple] = []
            for i in range(start, min(start + 200, batch.num_rows)):
                host = hosts[i].as_py()
                for path, (children, own) in parse(pages[i].as_py())[1].items():
                    if path:
                        if children:
                            rows.append((host, path, 0, hashed(children), 0))
                        if own:
                            rows.append((host, path, 1, hashed(own), len(own.split())))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=FEATURES.names)


def importance(pages: DataFrame, host: str, page: str) -> DataFrame:
    """(host, path, pages, importance, content, information, plain) of every node of every host's tree.

    ``content`` is the importance of the node's own text; ``information`` that of
    its branch, of which ``plain`` is the node's own.
    """
    seen = pages.filter(F.col(host) != "").select(host, page).mapInArrow(_features, FEATURES)
    counts = seen.groupBy("host", "path", "kind", "feature").agg(F.count(F.lit(1)).cast("double").alias("n"), F.max("words").alias("words"))
    words = F.col("n") * F.col("words")
    kinds = counts.groupBy("host", "path", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"), F.sum(words).alias("w"), F.sum(words * F.log("n")).alias("ws"))
    many = F.col("m") > 1
    entropy = F.when(many, F.greatest(F.lit(0.0), (F.log("m") - F.col("s") / F.col("m")) / F.log("m"))).otherwise(F.lit(1.0))
    told = F.when(many, F.greatest(F.lit(0.0), F.col("w") - F.col("ws") / F.log("m"))).otherwise(F.col("w"))
    nodes = kinds.select("host", "path", "kind", "m", entropy.alias("h"), told.alias("told"))
    # every node adds to the branches above it, to their importance less by GAMMA for each level
    steps = F.split(F.expr("substring(path, 2)"), "/")
    up = nodes.withColumn("steps", steps).withColumn("d", F.explode(F.sequence(F.lit(1), F.size("steps"))))
    weight = F.col("m") * F.pow(F.lit(GAMMA), F.size("steps") - F.col("d"))
    own = (F.col("kind") == 1) & (F.col("d") == F.size("steps"))
    up = up.select("host", F.concat(F.lit("/"), F.array_join(F.slice("steps", F.lit(1), F.col("d")), "/")).alias("path"), weight.alias("w"), (weight * F.col("h")).alias("wh"), "m", F.when(own, F.col("h")).alias("own"), "told", F.when(own, F.col("told")).alias("plain"))
    return up.groupBy("host", "path").agg(F.max("m").alias("pages"), (F.sum("wh") / F.sum("w")).alias("importance"), F.max("own").alias("content"), F.sum("told").alias("information"), F.coalesce(F.sum("plain"), F.lit(0.0)).alias("plain"))


def branches(tree: DataFrame) -> DataFrame:
    """(tree_host, known, low, dull, aside) of each host: whether it has pages enough, and its paths of little importance, of dull content, and beside the main branch."""
    deep = F.struct(F.size(F.split("path", "/")).alias("depth"), "path")
    hosts = tree.groupBy("host").agg(F.max("pages").alias("most"), F.sum("plain").alias("all"))
    mains = tree.join(hosts, "host").filter((F.col("information") >= MAIN * F.col("all")) & (F.col("plain") < MAIN * F.col("information")))
    mains = hosts.join(mains.groupBy("host").agg(F.max(deep)["path"].alias("main")), "host", "left")
    t = tree.join(mains, "host")
    inside = F.col("path").rlike(r"/(article|main)(\.[^/]*)?(/|$)")
    enough = F.col("pages") >= LEAST_PAGES
    low = F.when(inside, (F.col("importance") < LEAST_INSIDE) & (F.col("pages") >= ARTICLE_PAGES)).otherwise((F.col("importance") < LEAST) & enough)
    dull = F.coalesce(F.col("content") < LEAST, F.lit(False))
    under = lambda a, b: F.startswith(F.concat(a, F.lit("/")), F.concat(b, F.lit("/")))
    heading = F.col("path").rlike(r"/h[1-6](\.[^/]*)?$") & ~dull
    beside = ~inside & enough & ~heading & (F.col("information") < ASIDE * F.col("all")) & ~under(F.col("path"), F.col("main")) & ~under(F.col("main"), F.col("path"))
    kinds = {"low": low, "dull": dull, "aside": beside}
    lists = [F.collect_list(F.when(F.coalesce(c, F.lit(False)), F.col("path"))).alias(k) for k, c in kinds.items()]
    return t.groupBy(F.col("host").alias("tree_host")).agg((F.max("most") >= LEAST_PAGES).alias("known"), *lists)


def kept_texts(page: str | None, names: bool, known: bool, low: Iterable[str], dull: Iterable[str], aside: Iterable[str]) -> Iterator[str]:
    """The texts of a page's blocks that stay."""
    branches, nodes, besides = tuple(f"{c}/" for c in low), frozenset(dull), tuple(f"{c}/" for c in aside)
    for path, mark, t in parse(page)[0]:
        at = f"{path}/"
        falls = at.startswith(besides) or (at.startswith(branches) and (path in nodes or t.count(" ") < MENU_WORDS))
        told = names and (mark == 2 or (mark == 1 and not known))
        if not falls and not told:
            yield t


def extract(pages: DataFrame, url: str = "url", page: str = "html", names: bool = True) -> DataFrame:
    """pages with ``main_text``; without ``names`` the tree alone decides."""
    plain, name, back = positional(pages)
    host = F.regexp_extract(F.col(name(url)), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    named = plain.withColumn("host_", F.lower(F.coalesce(host, F.lit(""))))
    low = table(branches(importance(named, "host_", name(page))), "style-tree")
    size = low.agg(F.sum(F.octet_length(F.concat_ws(" ", "low", "dull", "aside", "tree_host")))).first()[0]
    if (size or 0) <= BROADCAST_BYTES:
        low = F.broadcast(low)
    slim = named.join(low, F.col("host_") == F.col("tree_host"), "left").select(*plain.columns, F.coalesce("known", F.lit(False)).alias("known"), "low", "dull", "aside")
    at, n = pages.columns.index(page), len(pages.columns)
    result = [*plain.columns, "main_text"]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = []
                for p, known, low, dull, aside in zip(part.column(at), *(part.column(n + k) for k in range(4))):
                    texts.append("\n\n".join(kept_texts(p.as_py(), names, known.as_py(), low.as_py() or (), dull.as_py() or (), aside.as_py() or ())))
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(texts, pa.string())], names=result)

    done = slim.mapInArrow(run, with_fields(plain.schema, ("main_text", T.StringType())))
    return back(done, "main_text")
