"""HTML main text by composite text density.

A page becomes a tree of elements (void and raw-text elements, implied end tags and unclosed tags as browsers read them).
Parts that are boilerplate by their element or by a word of their class, id or role are taken out; a word alone takes out no part
that holds a main, an h1, the page's only articles or, where nothing of the kind stands elsewhere, most of the running text. For every element left,
with C characters, T tags, LC characters and LT tags in links below it, and b the body,

    density = C / T * log(C / LC * T / LT) / log(ln(C / (C - LC) * LC + LC_b / C_b * C + e))

(zero denominators count as 1), and its density sum is that of its children. The element of the greatest density sum is
the core; the threshold is the least density on the path from it to the body. Siblings along that path join the core when
their density reaches the threshold, whatever their share of the text; next to the core,
headings, paragraphs, sections and parts of its class join as well, and so does the last h1 before it. A heading that announces comments, related pages or the
like ends the article part of its parent if it counts them or what comes next looks like comments or links. An enclosing ``article`` or ``main`` is taken whole, and an
article's fellows of half its size at least with it. Within an article, paragraphs named like tools and parts whose heading repeats
their name stay if they are running text of few links. Blocks of that subtree that are mostly links go, but for
an article's list of sources.

The text: character references decoded, white space inside a block turned into one space and trimmed, empty blocks left
out, blocks in page order joined by two line breaks; ``br`` is white space. Nothing else is dropped or cut.

Defined results: null, empty or text-free pages give the empty text; a page cut off anywhere is read up to there; repeated
rows give repeated results; very long pages are read whole, in memory of their size; an empty table gives no rows; columns
other than page_id, url and html are ignored.
"""

from __future__ import annotations

import html as html_module
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table

VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4
    h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul""".split()
)
#: Elements that are no article text, whatever their names.
NOISE = frozenset(
    """script style noscript template svg annotation annotation-xml canvas object embed iframe audio video map head title nav aside footer form button input select
    textarea label fieldset dialog menu search datalist noframes noembed xmp plaintext""".split()
)
#: Words of class, id, role and similar attributes that mark a part as no article text.
WORDS = frozenset(
    """ad ads adv alert alertdialog advert advertisement advertising advertorial adsense banner breadcrumb breadcrumbs captcha comment comments commentlist
    complementary consent contentinfo cookie cookies copyright disclaimer disqus discussion feedback footer gdpr legal login masthead menu modal nav
    navbar navigation newsletter notice notification overlay pager pagination paywall popup privacy promo promotion promoted recommendations recommended
    related replies reply respond search share sharing shoutbox sidebar sidenav signup skip social sponsor sponsored subscribe subscription tagcloud tags
    teaser toc toolbar topbar tracking widget widgets""".split()
)
#: Such words run together with others.
PARTS = re.compile(
    r"^(?:cookie|comment(?!ary)|sidebar|advert|sponsor|promo|newsletter|breadcrumb|social|footer|navbar|navig|popup|banner|subscri|disclaim|copyright|related|recommend)"
    r"|(?:nav|menu|banner|footer|sidebar|comments|cookies|advert)$"
)
#: A heading that says so ends the article part of its parent.
AFTER = re.compile(
    r"\W*(?:\d+ )?(?:(?:reader|user|leser|your) ?)?(?:comments?|kommentare?|commentaires?|comentarios?|responses|replies|discussion|leave a (?:comment|reply)|related (?:articles|posts|stories|news)"
    r"|share this(?: \w+)?|advertisement|subscribe|newsletter|more from us|you may also like)\W*(?:\(?\d+\)?\W*)?",
    re.I,
)
#: Words of parts that hold what readers write.
MARKS = frozenset("comment comments commentlist disqus feedback reply replies respond shoutbox".split())
#: Words that may name a section's subject as well: with a heading of its own and running text it is a part of its article.
SUBJECTS = frozenset("social legal privacy discussion feedback notice navigation banner disclaimer copyright tags related banners cookies sharing subscription skip".split())
#: Such words name things made of links or controls: a paragraph of running text in an article is none of them.
TOOLS = frozenset("menu nav navbar navigation breadcrumb breadcrumbs pager pagination toc toolbar topbar tracking tags tagcloud social share sharing search skip related recommended recommendations login".split())
#: Characters from which a paragraph is running text, and the share of links up to which.
RUNNING, FEW_LINKS = 100, 0.2
#: A heading before a list of linked sources.
SOURCES = re.compile(r"\W*(?:\d+\.? )?(?:references|bibliography|sources|notes|footnotes|works cited|citations|literature|literatur|quellen|einzelnachweise|bibliographie|références|bibliografía|referencias)\W*", re.I)
#: Class names that say what stands beside a part or is missing, not what it is.
BESIDE = re.compile(r"(?<!\S)(?:has|with|without|no)(?=[-_A-Z])\S*")
#: Marks of a page's own head; inside an article they hold its title.
HEAD_WORDS = frozenset("header banner masthead".split())
HEADINGS = frozenset("h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - frozenset("body html option select td th tr tbody thead tfoot caption legend".split())
#: An element's start ends an open one of these, up to the nearest of the second set.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
FENCE = frozenset("html body table td th caption template button article section main div object".split())
TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)", re.S)
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|aria-label|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "kind", "parent", "parts", "noise", "named", "chars", "tags", "link_chars", "link_tags", "density", "sum")

    def __init__(self, tag: str, parent: Node | None, noise: bool = False, kind: str = ""):
        self.tag, self.parent, self.noise, self.kind = tag, parent, noise, kind
        self.named: set[str] = set()  # the words for which alone it is noise
        self.parts: list[Node | str] = []


def _noise(tag: str, attributes: str, inside: bool) -> tuple[bool, set[str]]:
    """Whether an element is boilerplate, and the words if only they say so; ``inside``: within an article or main part."""
    if tag in NOISE or tag == "header" and not inside:
        return True, set()
    if not attributes or tag in ("html", "body", "article", "main"):
        return tag == "article" and bool(attributes) and bool(_words(attributes) & {"comment", "comments", "reply", "teaser", "promo", "ad", "sponsored", "related"}), set()
    words = _words(attributes)
    if "hidden!" in words:
        return True, set()
    found = {w for w in words if w in WORDS or w in HEAD_WORDS or PARTS.search(w)}
    found = found - HEAD_WORDS if inside or words & {"entry", "post", "article", "story"} else found
    return bool(found), found


def _words(attributes: str) -> set[str]:
    words: set[str] = set()
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value, name = a or b or c, name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            words.add("hidden!")
        elif name in ("class", "id", "role", "aria-label", "itemprop"):
            words.update(w.lower() for w in CAMEL.findall(BESIDE.sub("", value)))
    return words


class _Open(list):
    """Open elements, innermost last, with the number of each tag, so that a tag costs no walk over all of them."""

    def __init__(self, nodes: list[Node]):
        super().__init__(nodes)
        self.tags = Counter(x.tag for x in nodes)

    def count_of(self, tag: str) -> int:
        return self.tags[tag]

    def append(self, node: Node) -> None:
        self.tags[node.tag] += 1
        super().append(node)

    def __delitem__(self, part: slice) -> None:
        self.tags.subtract(x.tag for x in self[part])
        super().__delitem__(part)


def parse(page: str) -> Node:
    """The body (or the whole page where there is none) as a tree."""
    root = Node("html", None)
    stack = _Open([root])
    at, n = 0, len(page)

    def add(text: str) -> None:
        if text:
            stack[-1].parts.append(html_module.unescape(text) if "&" in text else text)

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        add(page[at:lt])
        found = TOKEN.match(page, lt) or LOOSE.match(page, lt)
        if not found:
            add("<" if page[lt + 1 : lt + 2] != "/" else "")
            at = lt + 1 if page[lt + 1 : lt + 2] != "/" else (page.find(">", lt) + 1 or n)
            continue
        at = found.end()
        if not found[2]:
            continue
        if page[at - 1] != ">":
            break  # the page ends within a tag
        tag, attributes = found[2].lower(), found[3]
        if found[1]:
            if tag in VOID:
                if tag == "br":
                    stack[-1].parts.append(" ")
                continue
            for k in range(len(stack) - 1, 0, -1) if stack.count_of(tag) else ():
                if stack[k].tag == tag:
                    if tag not in ("body", "html"):
                        del stack[k:]
                    break
                if tag not in BLOCK and stack[k].tag in FENCE or tag == "p" and stack[k].tag in FENCE:
                    break
            continue
        if tag in ("html", "body"):
            if stack.count_of("body") or tag == "html":
                continue
            del stack[1:]
        elif tag in BLOCK and stack.count_of("head"):
            del stack[next(k for k, s in enumerate(stack) if s.tag == "head") :]
        if tag in CLOSES_P and stack.count_of("p"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in FENCE:
                    break
        if tag in IMPLIED:
            ends, upto = IMPLIED[tag]
            cut = None
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    cut = k
                elif stack[k].tag in upto:
                    break
            if cut:
                del stack[cut:]
        inside = stack.count_of("article") + stack.count_of("main") > 0
        noise, named = _noise(tag, attributes, inside)
        node = Node(tag, stack[-1], noise, next((a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes) if k.lower() == "class"), ""))
        node.named = named
        stack[-1].parts.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            if not end:
                break
            at = page.find(">", end.end()) + 1 or n
        elif tag not in VOID and not attributes.rstrip().endswith("/" if tag in ("path", "circle", "rect", "use") else "\0"):
            stack.append(node)
    return next((p for p in root.parts if isinstance(p, Node) and p.tag == "body"), root)


def _clean(text: str) -> str:
    return " ".join(text.split())


def walk(body: Node) -> list[Node]:
    """Elements without noise, parents first."""
    out, rest = [], [body]
    while rest:
        node = rest.pop()
        out.append(node)
        rest += [p for p in reversed(node.parts) if isinstance(p, Node) and not p.noise]
    return out


def _rescue(body: Node) -> None:
    """Keeps parts that are noise by a word alone but hold the page's main text."""
    named, order, rest = [], [], [body]
    while rest:
        node = rest.pop()
        order.append(node)
        if node.named:
            named.append(node)
        rest += [p for p in node.parts if isinstance(p, Node) and (not p.noise or p.named)]
    if not named:
        return
    running: dict[int, int] = {}
    holds: dict[int, set[str]] = {}
    for node in reversed(order):
        parts = [p for p in node.parts if isinstance(p, Node) and id(p) in running]
        running[id(node)] = 0 if node.tag == "a" else sum(len(_clean(p)) for p in node.parts if isinstance(p, str)) + sum(running[id(p)] for p in parts)
        holds[id(node)] = {node.tag} & {"article", "main", "h1"} | {t for p in parts for t in holds[id(p)]}
    outside = {x.tag for x in walk(body)} & {"article", "main", "h1"}
    for node in named:
        of_kind = holds[id(node)] - outside
        most = not outside and running[id(node)] > 0.5 * running[id(body)]
        # such a section of an article is a part of it unless readers write there or it holds links
        section = node.tag == "section" and any(isinstance(p, Node) and p.tag in HEADINGS for p in node.parts)
        own = (section or node.named == {"discussion"}) and node.named <= SUBJECTS and _in_article(node) and not _reader_or_links([node])
        own = own or _running(node)
        if own or most or of_kind and not (of_kind == {"h1"} and node.named <= HEAD_WORDS):
            node.noise = False


def _running(node: Node) -> bool:
    """Whether a named part within an article is running text of it: a paragraph named like a tool, or a part with a heading that its name, of several words, describes."""
    if node.tag == "p":
        if not node.named <= TOOLS:
            return False
    else:
        first = next((p for p in node.parts if isinstance(p, Node)), None)
        if node.tag not in ("div", "section") or not node.named <= SUBJECTS or first is None or first.tag not in HEADINGS:
            return False
        says = _clean("".join(_strings(first)))
        own = {w.lower() for w in CAMEL.findall(says)}
        if AFTER.fullmatch(says) or not own & set(w.lower() for w in CAMEL.findall(node.kind)) - node.named:
            return False
    if not _in_article(node):
        return False
    chars = len(_clean("".join(_strings(node))))
    links = sum(len(_clean("".join(_strings(x)))) for x in walk(node) if x.tag == "a")
    return chars >= RUNNING and links <= FEW_LINKS * chars and not _reader_or_links([node])


def _in_article(node: Node) -> bool:
    while node.parent and node.tag not in ("article", "main"):
        node = node.parent
    return node.tag in ("article", "main")


def _reader_or_links(parts: list[Node]) -> bool:
    """Whether parts look like comments, by their first one, or like links."""
    first = walk(parts[0]) if parts else []
    for x in first:
        if any(isinstance(p, Node) and (p.named & MARKS or p.tag in ("form", "textarea") or p.noise and p.tag == "article") for p in [x, *x.parts]):
            return True
    chars = sum(len(_clean(t)) for p in parts for t in _strings(p))
    links = sum(len(_clean("".join(_strings(x)))) for p in parts for x in walk(p) if x.tag == "a")
    return links > 0.5 * chars or not chars


def _section(parts: list[Node | str], at: int) -> list[Node]:
    """What follows a heading up to the next one of its level."""
    out: list[Node] = []
    for p in parts[at + 1 :]:
        if isinstance(p, Node):
            if p.tag in ("h1", "h2", "h3", "h4", "h5", "h6") and p.tag <= parts[at].tag:
                break
            out.append(p)
    return out


def _drop_after(body: Node) -> None:
    """Takes out headings of comments and the like, with all that follows them in their parent."""
    for node in walk(body):
        ended = False
        for i, p in enumerate(node.parts):
            if isinstance(p, Node):
                if not ended and p.tag in HEADINGS and AFTER.fullmatch(says := _clean("".join(_strings(p)))):
                    ended = any(c.isdigit() for c in says) or _reader_or_links(_section(node.parts, i))
                p.noise = p.noise or ended


def _strings(node: Node) -> Iterator[str]:
    rest: list[Node | str] = [node]
    while rest:
        x = rest.pop()
        if isinstance(x, str):
            yield x
        else:
            rest += reversed(x.parts)


def densities(body: Node) -> list[Node]:
    """Sets counts, density and density sum of every element; parents first."""
    nodes = walk(body)
    for node in reversed(nodes):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for p in node.parts:
            if isinstance(p, str):
                node.chars += len(_clean(p))
            elif not p.noise:
                node.chars += p.chars
                node.tags += p.tags + 1
                node.link_chars += p.link_chars
                node.link_tags += p.link_tags + (p.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    share = body.link_chars / max(1, body.chars)
    for node in reversed(nodes):
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, max(1, node.link_tags)
        if c:
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            node.density = c / t * math.log(max(1.0, c / max(1, lc) * t / lt)) / max(1e-9, math.log(base) if base > math.e else 1.0)
        else:
            node.density = 0.0
        node.sum = sum(p.density for p in node.parts if isinstance(p, Node) and not p.noise)
    return nodes


def _path(node: Node, body: Node) -> list[Node]:
    out = [node]
    while out[-1] is not body:
        out.append(out[-1].parent)
    return out


def main_part(body: Node) -> list[Node]:
    """The subtrees that hold the article, in page order."""
    _rescue(body)
    _drop_after(body)
    nodes = densities(body)
    core = max(nodes, key=lambda x: x.sum)
    if not core.sum:
        return [body]
    path = _path(core, body)
    threshold = min(p.density for p in path)
    whole = [p for p in path if p.tag in ("article", "main")]
    if whole:
        # other articles beside it, of half its size at least and hardly any links, belong to the page's text as well
        beside = whole[0].parent.parts if whole[0].tag == "article" and whole[0].parent else whole
        fellow = lambda p: isinstance(p, Node) and p.tag == "article" and not p.noise and 2 * p.chars >= whole[0].chars and p.link_chars <= 0.1 * p.chars
        return [p for p in beside if p is whole[0] or fellow(p)]
    if core.tag in ("ul", "ol", "dl", "table", "tbody", "tr") and core.parent:
        core = core.parent
        path = _path(core, body)
    # a core of one article part: siblings along the path that read like it join
    keep, level = {id(core)}, core
    for up in path[1:]:
        for p in up.parts:
            if isinstance(p, Node) and not p.noise and p is not level and p.tag in BLOCK:
                like = p.chars and p.density >= threshold or up is path[1] and (p.tag in ("h1", "h2", "p") or (p.tag, p.kind) == (core.tag, core.kind) and (p.kind or p.tag == "section"))
                if like and p.link_chars <= 0.3 * p.chars:
                    keep.add(id(p))
        level = up
    # the title, where it stands before the core in a part of its own
    if not any(x.tag == "h1" for x in walk(core)) and len(path) > 1:
        before = [x for x in walk(path[1]) if x.tag == "h1" or x is core]
        titles = before[: before.index(core)]
        if titles and not any(id(x) in keep for x in _path(titles[-1], body)):
            keep.add(id(titles[-1]))
    return [x for x in nodes if id(x) in keep]


def blocks(part: Node) -> list[str]:
    """Texts of the blocks below ``part`` in page order."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = _clean("".join(run))
        run.clear()
        if text:
            out.append(text)

    rest: list[Node | str | None] = [part]
    while rest:
        x = rest.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x is part or not x.noise and not _links(x):
            block = x.tag in BLOCK
            if block:
                flush()
                rest.append(None)
            elif x.tag in ("br", "wbr"):
                run.append(" " if x.tag == "br" else "")
            rest += reversed(x.parts)
    flush()
    return out


def _links(node: Node) -> bool:
    """A block (no paragraph or heading) that is mostly links, of two links at least."""
    if node.tag not in BLOCK or node.tag in ("p", "h1", "li", "td", "blockquote") or node.tag in HEADINGS or node.link_tags < 2 or node.link_chars <= 0.6 * node.chars:
        return False
    return not (node.tag in ("ol", "ul", "section", "div") and _in_article(node) and _sources(node))


def _sources(node: Node) -> bool:
    """Whether a list of links stands under a heading that announces sources."""
    before = None
    for p in [*node.parent.parts[: next(i for i, x in enumerate(node.parent.parts) if x is node)], *node.parts] if node.parent else []:
        if isinstance(p, Node) and (p.tag in HEADINGS or p.tag == "h1"):
            before = p
    return before is not None and bool(SOURCES.fullmatch(_clean("".join(_strings(before)))))


def main_text(page: str | None) -> str:
    if not page:
        return ""
    body = parse(page.replace("\0", "�"))
    return "\n\n".join(b for part in main_part(body) for b in blocks(part))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    small_batches(pages.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return pages.select("page_id", "url", "html").mapInArrow(work, "page_id long, url string, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract(table(spark, sf_dir, "pages"))
