"""Main text of pages, with container paths agreed on by each host.

Every page is parsed into containers.  A container's good text is what its subtree shows
outside of menus, headers, footers, asides, forms, adverts, notices and comments, less the
text of links.  The containers that hold most of a page's good text are scored by that
share, by their element and by their class; each score is a vote for the container's path,
where digits in classes are generalised away.  Votes are summed per host and path in
Spark; pages are then extracted again from the container whose path has the most votes on
their host.  All paths of a host count, however many it has; html and body, which all
templates share, are chosen only where no container inside them holds enough.

Defined results: null html is the empty page, whose text is empty; a null address has the
empty host; repeated rows give repeated results; other columns are ignored; an empty table
gives no rows; pages are read whole.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, materialise, settled, slices

#: Elements by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg select xmp".split())
SKIPPED = RAW | frozenset(
    "nav header footer aside form button dialog menu label input object canvas audio video head".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("html body div section article main td center blockquote".split())
CLOSED_BY_BLOCK = frozenset("p".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table div section article main body html td aside nav".split())
#: Words of what is no main text.  A class or role that is one of them marks its
#: element whatever that holds; one with a further part (``sidebar-left``, ``top-banner``) marks
#: an element that holds no article.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav "
    "navbar navigation breadcrumb breadcrumbs footer header masthead comment comments respond replies discussion "
    "disqus share sharing social related recommended newsletter subscribe subscription signup login cookie cookies "
    "consent gdpr notice notification alert popup modal overlay disclaimer copyright pagination pager toolbar widget "
    "widgets search skip hidden complementary contentinfo".split()
)
#: First parts after which a second says what an element has, lacks or is about.
MODIFIERS = frozenset("has no not with without is tag category cat topic type format hide show js".split())
#: Elements that neither a class nor a role makes boilerplate, and those of which an id says
#: nothing since it only names a place.
NEVER = frozenset("html body main".split())
ANCHORS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd span a td th tr".split())
_PARTS = re.compile(r"[-_]+")
FAVOURED = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|body|text|main)(?:$|[\s_-])", re.I)
ELEMENT_WEIGHT = {"article": 1.5, "main": 1.3, "body": 0.7, "html": 0.6}
#: The least share of a page's good text in a container that gets votes.
LEAST_SHARE = 0.6
SPELLED = 12
#: Containers that the templates of a host share.
SHARED = frozenset(("html", "body"))
#: Paths up to which the votes are broadcast; beyond, a salted join brings each page the
#: votes of its own paths.
BROADCAST_PATHS = 160_000
SALTS = 64

# A quote opens a value only after an equals sign.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|"
    r"<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_DIGITS = re.compile(r"\d+")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


def marked(words: Iterable[str]) -> int:
    """2 if a word of classes, ids or roles is boilerplate, 1 if one has it as a part."""
    found = 0
    for word in words:
        word = word.lower()
        if word in BOILERPLATE:
            return 2
        parts = _PARTS.split(word)
        if len(parts) > 1 and parts[0] not in MODIFIERS and (parts[0] in BOILERPLATE or parts[-1] in BOILERPLATE):
            found = 1
    return found


class Node:
    """An element: its children are nodes and texts."""

    __slots__ = ("tag", "marks", "mark", "hidden", "children", "parent")

    def __init__(self, tag: str, classes: str = "", own_id: str = "", hidden: bool = False, parent: Node | None = None):
        self.tag, self.hidden, self.parent = tag, hidden, parent
        self.marks = f"{classes} {own_id}".strip() if own_id else classes
        self.mark = marked((classes if tag in ANCHORS else self.marks).split()) if self.marks else 0
        self.children: list[Node | str] = []

    def holds_article(self) -> bool:
        """Whether an article or main element that is not boilerplate itself is inside."""
        stack = [c for c in self.children if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            if node.tag == "main" or node.tag == "article" and node.mark < 2:
                return True
            stack.extend(c for c in node.children if isinstance(c, Node))
        return False

    def skipped(self) -> bool:
        """Whether it is no part of the main text.  Of an article only a whole word can say so."""
        if self.tag in SKIPPED or self.hidden:
            return True
        if not self.mark or self.tag in NEVER:
            return False
        return self.mark == 2 or self.tag != "article" and not self.holds_article()


def parse(page: str) -> Node:
    """The element tree of a page, as browsers would nest it, near enough."""
    root = Node("html")
    at, node = 0, root
    position = 0
    while match := _TOKEN.search(page, position):
        if match.start() > at:
            node.children.append(page[at : match.start()])
        at = position = match.end()
        name = match[2]
        if not name:
            continue
        name = name.lower()
        if match[1]:
            up = node
            while up is not None and up.tag != name:
                if name == "p" and up.tag in SCOPES:
                    up = None
                    break
                up = up.parent
            if up is not None and up.parent is not None:
                node = up.parent
            elif name == "p":
                node.children.append(Node("p", parent=node))
            continue
        if name == "html":
            continue
        if name in BLOCKS:
            up = node
            while up.tag not in SCOPES and up.tag not in CLOSED_BY_BLOCK and up.parent is not None:
                up = up.parent
            if up.tag in CLOSED_BY_BLOCK:
                node = up.parent
        if name in SIBLINGS:
            up = node
            while up.tag not in SIBLINGS[name] and up.tag not in SCOPES - {"td"} and up.parent is not None:
                up = up.parent
            while up.tag in SIBLINGS[name] and up.parent is not None:
                node = up.parent
                up = node
        classes, own_id, hidden = "", "", False
        if match[3] and not match[3].isspace():
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(match[3])}
            classes = " ".join(found[k] for k in ("class", "role") if found.get(k))
            own_id = found.get("id", "")
            hidden = "hidden" in found or found.get("aria-hidden") == "true" or bool(_HIDDEN.search(found.get("style", "")))
        child = Node(name, classes, own_id, hidden, node)
        node.children.append(child)
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            at = position = end.end() if end else len(page)
        elif name not in VOID and not match[0].endswith("/>"):
            node = child
    if at < len(page):
        node.children.append(page[at:])
    return root


def generalised(found: list[tuple[Node, float]]) -> list[str]:
    """The paths of a page's candidates: elements and classes from the root on, without digits;
    below ``SPELLED`` levels, the container itself and a digest of all that is above it.

    Candidates hold most of a page's text each, so they stand inside one another and their
    paths come from one way up.
    """
    if not found:
        return []
    way, node = [], max(found, key=lambda x: _depth(x[0]))[0]
    while node is not None:
        way.append(node)
        node = node.parent
    names, path = {}, ""
    for level, node in enumerate(reversed(way)):
        marks = ".".join(sorted(_DIGITS.sub("#", node.marks).split()))
        step = f"{node.tag}.{marks}" if marks else node.tag
        if level >= SPELLED:
            path = hashlib.blake2b(path.encode(), digest_size=8).hexdigest()
        path = f"{path}>{step}" if path else step
        names[id(node)] = path
    return [names[id(node)] for node, _ in found]


def _depth(node: Node) -> int:
    depth = 0
    while node.parent is not None:
        node, depth = node.parent, depth + 1
    return depth


def candidates(root: Node) -> list[tuple[Node, float]]:
    """Containers with most of a page's good text, and their scores."""
    good: dict[int, float] = {}
    nodes: list[Node] = []
    order: list[tuple[Node, bool]] = [(root, False)]
    walk: list[tuple[Node, bool]] = []
    while order:
        node, linked = order.pop()
        linked = linked or node.tag == "a"
        walk.append((node, linked))
        order.extend((c, linked) for c in node.children if isinstance(c, Node) and not c.skipped())
    for node, linked in reversed(walk):
        own = sum(good.get(id(c), 0.0) if isinstance(c, Node) else (0 if linked else len(c.strip())) for c in node.children)
        good[id(node)] = own
        if node.tag in CONTAINERS:
            nodes.append(node)
    total = good[id(root)]
    if total <= 0:
        return []
    out = []
    for node in reversed(nodes):
        share = good[id(node)] / total
        if share >= LEAST_SHARE:
            weight = ELEMENT_WEIGHT.get(node.tag, 1.0)
            if node.marks and FAVOURED.search(node.marks):
                weight *= 1.25
            out.append((node, share * weight))
    return out


def blocks(container: Node) -> list[str]:
    """Texts of the blocks of a container, in order, without what is no main text."""
    out: list[str] = []
    current: list[str] = []

    def flush() -> None:
        text = " ".join(_html.unescape("".join(current)).split())
        if text:
            out.append(text)
        current.clear()

    headed = container.tag not in ("html", "body")
    # Entries to come: a text, a node, or None for the end of a block.
    stack: list[Node | str | None] = list(reversed(container.children))
    while stack:
        item = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            current.append(item)
        elif headed and not item.hidden and (item.tag == "header" or "header" in item.marks.lower().split()):
            # An article's own header gives its headings; what else it says is no text.
            flush()
            stack.append(None)
            stack.extend(reversed([c for c in item.children if isinstance(c, Node) and c.tag in _HEADING]))
        elif item.skipped():
            if item.tag in BLOCKS:
                flush()
            else:
                current.append(" ")
        elif item.tag == "br":
            current.append(" ")
        elif item.tag in BLOCKS:
            flush()
            stack.append(None)
            stack.extend(reversed(item.children))
        else:
            stack.extend(reversed(item.children))
    flush()
    return out


def main_text(page: str, agreed: dict[str, int] | None = None) -> str:
    """The main text of a page; ``agreed`` has the votes of its host's paths."""
    root = parse(page)
    found = candidates(root)
    if not found:
        return ""
    best = max(found, key=lambda x: x[1])[0]
    if agreed:
        voted = [(agreed.get(path, 0), s, n) for path, (n, s) in zip(generalised(found), found)]
        inner = [x for x in voted if x[0] > 0 and x[2].tag not in SHARED]
        top = max(inner or voted, key=lambda x: x[:2])
        if top[0] > 0:
            best = top[2]
    return "\n\n".join(blocks(best))


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path_votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes) over all pages; votes are thousandths of scores, as integers, so
    that their sums do not depend on an order."""
    out = pa.schema([("host", pa.string()), ("path", pa.string()), ("votes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: dict[tuple[str, str], int] = {}
            for part in slices(batch):
                for host, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = candidates(parse(page))
                    for path, (_, score) in zip(generalised(found), found):
                        votes[host, path] = votes.get((host, path), 0) + round(1_000 * score)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in votes]), pa.array([k[1] for k in votes]), pa.array(list(votes.values()), pa.int64())],
                schema=out,
            ) if votes else pa.RecordBatch.from_pylist([], schema=out)

    rows = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    cast = in_arrow(rows, run, "host string, path string, votes long")
    return cast.groupBy("host", "path").agg(F.sum("votes").alias("votes"))


def page_votes(rows: DataFrame, votes: DataFrame) -> DataFrame:
    """``rows`` (with host and html) with the paths of the page's own containers and their
    votes: paths meet votes by host and path, and pages by host and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 512):
                found = [sorted(set(generalised(candidates(parse(page))))) for page in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(found, pa.list_(pa.string()))], names=["host", "digest", "own"]
                )

    marked = rows.withColumn("digest", F.sha2("html", 256))
    own = in_arrow(marked.select("host", "digest", "html"), run, "host string, digest string, own array<string>")
    salt = F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int")
    wanted = own.select("host", "digest", F.explode("own").alias("path")).distinct().withColumn("salt", salt)
    salted = votes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    of_page = (
        wanted.join(salted, ["host", "path", "salt"])
        .groupBy("host", "digest")
        .agg(F.sort_array(F.collect_list(F.struct("path", "votes"))).alias("agreed"))
        .select("host", "digest", F.col("agreed.path").alias("paths"), F.col("agreed.votes").alias("votes"))
    )
    return marked.join(of_page, ["host", "digest"], "left")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    votes = materialise(path_votes(pages))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        host_of(F.col("url")).alias("host"),
        F.coalesce("html", F.lit("")).alias("html"),
    )
    known = None
    if votes.count() <= BROADCAST_PATHS:
        by_host: dict[str, dict[str, int]] = {}
        for r in votes.collect():
            by_host.setdefault(r["host"], {})[r["path"]] = r["votes"]
        known = pages.sparkSession.sparkContext.broadcast(by_host)
        given = rows.select("page_id", "url", "html", "host")
    else:
        given = page_votes(rows, votes).select("page_id", "url", "html", "paths", "votes")
    names = ["page_id", "url", "text", "n_chars"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64()]
    out = pa.schema(list(zip(names, types)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 512):
                got = part.to_pydict()
                if known is not None:
                    agreed = [known.value.get(host) for host in got["host"]]
                else:
                    agreed = [dict(zip(p, v)) if p else None for p, v in zip(got["paths"], got["votes"])]
                texts = [main_text(page, paths) for page, paths in zip(got["html"], agreed)]
                columns = [got["page_id"], got["url"], texts, [len(t) for t in texts]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], schema=out)

    return in_arrow(given, run, "page_id long, url string, text string, n_chars long")
