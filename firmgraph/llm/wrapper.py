"""Main text of HTML pages by wrapper induction.

The pages of a host share a layout. All pages vote on it: for each host and layout (the containers near the top of the page)
one reference page is chosen, every page's DOM tree is aligned with it by simple tree matching (children of matched nodes are
matched in order, so that the number of matched nodes is greatest), and the texts at each node of the reference are counted
over all pages by Spark. A node whose text is the same in most of the pages that have it is constant: template. The others,
and what pages have beside the reference's nodes, are slots. The content region is the lowest container that holds
DOMINANT of the characters in slots. Everything outside of it is left out, and everything in it stays, also texts that many
pages share; only where no container stands out from the page's body, constant parts of the body are left out.

What HTML itself names as no content - navigation, headers, footers, asides, forms, scripts, adverts, notices, comments - is
never content. Where a host has too few pages to tell (under LEAST), or a page does not match its wrapper, its article or main
element is the region, or without one the body.

Every layout with LEAST pages has a wrapper, however many layouts its host has. Pages of layouts with fewer, which cannot tell
what is constant, vote on the host's most frequent layout and take its wrapper if it fits: if its region holds DOMINANT of the
characters that are not constant on the page too. A wrapper is a row, which goes to its pages by broadcast if the measured size
of all allows, else by a join that Spark can split for layouts with very many pages.

Matching is exact for children lists whose product is at most EXACT; longer ones are first cut at children whose shape occurs
once on both sides, and what is left is read side by side, skipping to the next equal shape within NEAR. Weights of subtrees
beyond EXACT are estimated by their children's shapes. So time grows with the page, and depth needs no recursion.

Defined results: null and empty html give an empty text; pages without host are one host; hosts with fewer than LEAST pages
have no wrapper; unclosed and misplaced tags are closed as a browser would for blocks, and text of an unfinished tag is text;
ties between references and layouts go by hashes of the pages; repeated rows count as often as they occur and are extracted
alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from firmgraph.llm.common import Workspace, broadcast_if_small

SHARE, LEAST, DOMINANT, EXACT, NEAR = 0.6, 3, 0.75, 4096, 32
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|textarea|title|iframe|template)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("body html td th tr tbody thead tfoot option".split())
NO_CONTENT = frozenset("head nav header footer aside form button select option menu dialog svg object".split())
NO_ROLE = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar form".split())
NO_CLASS = frozenset(
    "ad ads advert adverts advertisement advertising sponsored promo promotion sponsor banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies consent notice notices popup modal newsletter subscribe subscription social share sharing related recommended comment comments commentlist disqus respond pagination pager widget hidden".split()
)
CONTAINERS = frozenset("article blockquote body center div main section table tbody td tr".split())
SIBLINGS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}


class Node:
    __slots__ = ("tag", "attrs", "out", "children", "texts", "shape", "size")

    def __init__(self, tag: str, out: bool = False, attrs: str = ""):
        self.tag, self.attrs, self.out, self.children, self.texts = tag, attrs, out, [], []


def _no_content(tag: str, attrs: str) -> bool:
    if tag in NO_CONTENT:
        return True
    if not attrs:
        return False
    for name, *values in ATTRIBUTE.findall(attrs):
        value, name = "".join(values).lower(), name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in NO_ROLE:
            return True
        if name in ("class", "id") and any(w in NO_CLASS for w in re.split(r"[^a-z0-9]+", value)) and tag not in ("body", "html", "article", "main"):
            return True
    return False


def parse(page: str | None) -> Node:
    """The DOM tree; a node's texts are (number of children before, text)."""
    root = Node("#root")
    stack, at, page = [root], 0, page or ""
    add = lambda text: text and stack[-1].texts.append((len(stack[-1].children), text))
    for m in TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        if not (tag := m["tag"]):
            continue
        tag = tag.lower()
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("article", "main", "body", "table") and tag not in BLOCKS:
                    break
            continue
        if tag in CLOSES_P:
            _close(stack, {"p"}, frozenset(("td", "th", "button", "object")))
        if tag in SIBLINGS:
            _close(stack, {"td", "th"} if tag in ("td", "th") else {"dt", "dd"} if tag in ("dt", "dd") else {tag}, SIBLINGS[tag])
        node = Node(tag, stack[-1].out or _no_content(tag, m["attrs"]), m["attrs"])
        stack[-1].children.append(node)
        if tag not in VOID and not m["attrs"].endswith("/"):
            stack.append(node)
    add(page[at:])
    return root


def _close(stack: list[Node], tags: set[str], stop: frozenset[str] | set[str]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in stop or stack[i].tag in ("article", "main", "body", "section", "div", "blockquote"):
            return


def clean(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def own_text(node: Node) -> str:
    return clean(" ".join(t for _, t in node.texts)) if node.texts else ""


def signature(text: str) -> int:
    """A hash of a text, 0 without any."""
    return zlib.crc32(text.encode("utf-8", "replace")) | 1 << 32 if text else 0


def body_of(root: Node) -> Node:
    """The body element, or else the root."""
    for top in (root, *root.children):
        for n in top.children:
            if n.tag == "body":
                return n
    return root


def layout(root: Node) -> int:
    """A hash of the containers, with their first class or id, on the two levels under the body."""
    found, level = set(), [body_of(root)]
    for depth in (1, 2):
        level = [c for n in level for c in n.children if c.tag in CONTAINERS or c.tag in NO_CONTENT]
        for n in level:
            named = ATTRIBUTE.search(n.attrs) if n.attrs else None
            found.add(f"{depth} {n.tag} {''.join(x or '' for x in named.groups()).lower() if named else ''}")
    return zlib.crc32("|".join(sorted(found)).encode("utf-8", "replace"))


def shapes(root: Node) -> None:
    """Set the size of each subtree and a hash of its tags."""
    order = [root]
    for n in order:
        order += n.children
    for n in reversed(order):
        n.shape, n.size = hash((n.tag, *[c.shape for c in n.children])), 1 + sum(c.size for c in n.children)


def align(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Simple tree matching: the pairs of nodes of a largest matching of two trees whose roots are matched."""
    found, todo = [], [(a, b)]
    memo: dict[tuple[int, int], int] = {}
    while todo:
        x, y = todo.pop()
        found.append((x, y))
        if x.children and y.children:
            todo += _matched(x.children, y.children, memo)
    return found


def _matched(xs: list[Node], ys: list[Node], memo: dict) -> list[tuple[Node, Node]]:
    """Pairs of two lists of children, in order.

    Children of the same shape at both ends are matched at once: a pair that matches whole cannot be improved on.
    """
    low, high = 0, 0
    while low < min(len(xs), len(ys)) and xs[low].shape == ys[low].shape:
        low += 1
    while high < min(len(xs), len(ys)) - low and xs[-1 - high].shape == ys[-1 - high].shape:
        high += 1
    pairs = list(zip(xs[:low], ys[:low])) + list(zip(xs[len(xs) - high :], ys[len(ys) - high :]))
    xs, ys = xs[low : len(xs) - high], ys[low : len(ys) - high]
    if xs and ys:
        pairs += _largest(xs, ys, memo) if len(xs) * len(ys) <= EXACT else _anchored(xs, ys, memo)
    return pairs


def _largest(xs: list[Node], ys: list[Node], memo: dict) -> list[tuple[Node, Node]]:
    """The pairs that match most nodes."""
    table = _table(xs, ys, memo)
    i, j, pairs = len(xs), len(ys), []
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((xs[i], ys[j]))
    return pairs


def _table(xs: list[Node], ys: list[Node], memo: dict) -> list[list[int]]:
    table = [[0] * (len(ys) + 1)]
    for x in xs:
        last, row = table[-1], [0]
        for j, y in enumerate(ys):
            best = max(last[j + 1], row[j])
            if x.tag == y.tag and last[j] + min(x.size, y.size) > best:
                best = max(best, last[j] + _weight(x, y, memo))
            row.append(best)
        table.append(row)
    return table


def _weight(x: Node, y: Node, memo: dict) -> int:
    """Nodes of the largest matching of two subtrees with the same tag, or an estimate for large ones."""
    if x.shape == y.shape:
        return x.size
    if not x.children or not y.children:
        return 1
    key = (id(x), id(y))
    if key not in memo:
        if x.size * y.size <= EXACT:  # at most 64 levels deep
            memo[key] = 1 + _table(x.children, y.children, memo)[-1][-1]
        else:
            sizes = {c.shape: c.size for c in x.children}
            both = Counter(c.shape for c in x.children) & Counter(c.shape for c in y.children)
            memo[key] = 1 + max(sum(n * sizes[s] for s, n in both.items()), min(len(x.children), len(y.children)))
    return memo[key]


def _anchored(xs: list[Node], ys: list[Node], memo: dict) -> list[tuple[Node, Node]]:
    """Pairs of long lists: the longest run in order of shapes that occur once on both sides, then what is between them."""
    once = lambda ns: {s for s, n in Counter(c.shape for c in ns).items() if n == 1}
    both = once(xs) & once(ys)
    at = {y.shape: j for j, y in enumerate(ys) if y.shape in both}
    points = [(i, at[x.shape]) for i, x in enumerate(xs) if x.shape in both]
    tops, ends, back = [], [], []  # longest increasing run of j
    for k, (_, j) in enumerate(points):
        t = bisect_left(tops, j)
        tops[t : t + 1], ends[t : t + 1] = [j], [k]
        back.append(ends[t - 1] if t else -1)
    run, k = [], ends[-1] if ends else -1
    while k >= 0:
        run.append(points[k])
        k = back[k]
    pairs, i, j = [], 0, 0
    for p, q in [*reversed(run), (len(xs), len(ys))]:
        if i < p and j < q:
            pairs += _largest(xs[i:p], ys[j:q], memo) if (p - i) * (q - j) <= EXACT else _next_alike(xs[i:p], ys[j:q])
        if p < len(xs) and q < len(ys):
            pairs.append((xs[p], ys[q]))
        i, j = p + 1, q + 1
    return pairs


def _next_alike(xs: list[Node], ys: list[Node]) -> list[tuple[Node, Node]]:
    """Pairs of two lists read side by side: on a difference, the side that meets the other's shape sooner skips to it."""
    pairs, i, j = [], 0, 0
    while i < len(xs) and j < len(ys):
        if xs[i].shape != ys[j].shape:
            skip = next(((d, e) for n in range(1, NEAR) for d, e in ((n, 0), (0, n)) if i + d < len(xs) and j + e < len(ys) and xs[i + d].shape == ys[j + e].shape), None)
            if skip:
                i, j = i + skip[0], j + skip[1]
            elif xs[i].tag != ys[j].tag:
                i, j = (i + 1, j) if len(xs) - i > len(ys) - j else (i, j + 1)
                continue
        pairs.append((xs[i], ys[j]))
        i, j = i + 1, j + 1
    return pairs


def nodes(root: Node) -> list[Node]:
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += reversed(n.children)
    return order


def observed(reference: Node, places: dict[int, int], page: Node) -> Iterator[tuple[int, int, int]]:
    """What a page has at the nodes of its reference: (node, signature of the text, characters).

    Signature 0 stands for texts of nodes that the reference lacks, at the lowest node around them that it has.
    """
    at = {id(y): places[id(x)] for x, y in align(reference, page)}
    todo = [(page, 0)]
    while todo:
        n, around = todo.pop()
        own = at.get(id(n), -1)
        if not n.out and (text := own_text(n)):
            yield (own, signature(text), len(text)) if own >= 0 else (around, 0, len(text))
        around = own if own >= 0 else around
        todo += [(c, around) for c in n.children]


@dataclass
class Wrapper:
    """A reference page with its content region, and the constant texts that are left out of it."""

    root: Node
    region: Node
    template: dict[int, int]  # by id of a node of the reference: the signature of its text
    constant: dict[int, int]  # likewise, for all constant texts


def load_wrapper(page: str, seen: list[tuple[int, int, int, int, int, int]]) -> Wrapper | None:
    """The wrapper of a reference page by what all pages have at its nodes; None if nothing varies.

    seen has, for each node: its place, the number of pages, the signature of its most frequent text, how many pages have that
    and with how many characters, and the characters of all pages.
    """
    root = parse(page)
    shapes(root)
    order = nodes(root)
    place = {id(n): i for i, n in enumerate(order)}
    parent = [-1] * len(order)
    for i, n in enumerate(order):
        for c in n.children:
            parent[place[id(c)]] = i
    constant, slots = {}, [0] * len(order)
    for i, pages, sign, same, same_chars, chars in seen:
        if sign and same >= LEAST and same >= SHARE * pages:
            constant[i] = sign
            slots[i] = chars - same_chars
        else:
            slots[i] = chars
    own = list(slots)
    for i in range(len(order) - 1, 0, -1):
        slots[parent[i]] += slots[i]
    body = place[id(body_of(root))]
    if not slots[body]:
        return None
    region = body
    while order[region].tag != "article":
        inner = [i for i in (place[id(c)] for c in order[region].children) if order[i].tag in CONTAINERS and not order[i].out and slots[i] >= DOMINANT * slots[region]]
        if not inner:
            break
        region = inner[0]
    lifted = region == body
    if order[region].tag not in ("article", "main"):
        above = set(_up(parent, region))
        heading = next((i for i, n in enumerate(order) if n.tag == "h1" and not n.out and slots[i]), region)
        while heading not in above:
            heading = parent[heading]
        if heading != region and body in _up(parent, heading):  # a heading that varies belongs to the content
            region, lifted = heading, True
    template: dict[int, int] = {}
    if lifted:
        todo = list(order[region].children)
        while todo:
            n = todo.pop()
            i = place[id(n)]
            if i in constant and not slots[i]:
                template[id(n)] = constant[i]
            if not own[i]:
                todo += n.children
    return Wrapper(root, order[region], template, {id(order[i]): sign for i, sign in constant.items()})


def _up(parent: list[int], i: int) -> Iterator[int]:
    while i >= 0:
        yield i
        i = parent[i]


def _fits(wrapper: Wrapper, pairs: list[tuple[Node, Node]], root: Node) -> bool:
    """Whether a page has DOMINANT of the characters that are not constant in the region of a wrapper of another layout."""
    known = {id(b): wrapper.constant[id(a)] for a, b in pairs if id(a) in wrapper.constant}
    chars = lambda n: 0 if n.out or not (text := own_text(n)) or known.get(id(n)) == signature(text) else len(text)
    inside = sum(chars(n) for a, b in pairs if a is wrapper.region for n in nodes(b))
    return inside >= DOMINANT * sum(map(chars, nodes(root)))


def extract(page: str | None, wrapper: Wrapper | None = None, own: bool = True) -> str:
    """The content blocks of a page, joined by empty lines; own: whether the wrapper is of the page's layout."""
    root = parse(page)
    tops: list[Node] = []
    drop: set[int] = set()
    if wrapper is not None:
        shapes(root)
        pairs = align(wrapper.root, root)
        for a, b in pairs if own or _fits(wrapper, pairs, root) else ():
            if a is wrapper.region and not b.out:
                tops = [b]
            if id(a) in wrapper.template and wrapper.template[id(a)] == signature(own_text(b)):
                drop.add(id(b))
    if not tops or wrapper.region.tag == "body" or wrapper.region is wrapper.root:
        named = [n for n in nodes(root) if n.tag in ("article", "main") and not n.out]
        inside = set()
        for n in named:
            if id(n) not in inside:
                inside.update(id(c) for x in n.children for c in nodes(x))
        tops = [n for n in named if id(n) not in inside] or tops or [root]
    blocks: list[str] = []
    held: list[str] = []

    def flush():
        if text := clean("".join(held)):
            blocks.append(text)
        held.clear()

    for top in tops:
        todo: list = [top]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                held.append(n) if n else flush()
                continue
            if n.out or n.tag == "br":
                held.append(" ")
                continue
            steps: list = []
            texts = iter(() if id(n) in drop else n.texts)
            t = next(texts, None)
            for i in range(len(n.children) + 1):
                while t is not None and t[0] == i:
                    steps.append(t[1])
                    t = next(texts, None)
                if i < len(n.children):
                    steps.append(n.children[i])
            if n.tag in BLOCKS or n is top:
                flush()
                steps.append("")  # ends the block
            todo += reversed(steps)
        flush()
    return "\n\n".join(blocks)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


@F.arrow_udf(LongType())
def layout_of(html: pa.Array) -> pa.Array:
    return pa.array([layout(parse(page)) for page in html.to_pylist()], pa.int64())


def references(pages: DataFrame) -> DataFrame:
    """host, layout, html, n of the layouts of each host; a row for each."""
    # long pages are references only where there is no other
    rank = F.struct(F.floor(F.length("html") / 16384), F.xxhash64("html"), "html")
    known = pages.filter("html IS NOT NULL").select(host_of(F.col("url")).alias("host"), "html", rank.alias("rank"))
    return known.withColumn("layout", layout_of("html")).groupBy("host", "layout").agg(F.min("rank")["html"].alias("html"), F.count("*").alias("n"))


def induce_wrappers(pages: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """host, main, many: the hosts with LEAST pages, their most frequent layout, and whether there are others; and host, layout, reference, seen:
    that layout and each with LEAST pages, with its reference page and what its pages have at the nodes of that."""
    found = work.save(references(pages), "layouts")
    most = F.min(F.struct((-F.col("n")).alias("less"), "layout"))["layout"].alias("main")
    hosts = work.save(found.groupBy("host").agg(F.sum("n").alias("all"), most, (F.count("*") > 1).alias("many")).filter(F.col("all") >= LEAST).select("host", "main", "many"), "hosts")
    kept = found.join(broadcast_if_small(hosts, 256), "host").filter((F.col("n") >= LEAST) | (F.col("layout") == F.col("main")))
    listed = work.save(kept.select("host", "layout", F.col("html").alias("reference")), "references")
    fed = _with_wrappers(pages.filter("html IS NOT NULL"), hosts, listed).filter("reference IS NOT NULL").select("host", "layout", "html", "reference")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[str, tuple] = {}
        for batch in batches:
            counts: Counter = Counter()
            for host, own, page, text in zip(*(batch.column(c).to_pylist() for c in ("host", "layout", "html", "reference"))):
                root = parse(page)
                shapes(root)
                if text not in loaded:
                    if len(loaded) >= 100:
                        loaded.clear()
                    reference = parse(text)
                    shapes(reference)
                    loaded[text] = reference, {id(n): i for i, n in enumerate(nodes(reference))}
                counts.update((host, own, *x) for x in observed(*loaded[text], root))
            columns = list(zip(*counts)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), pa.array(counts.values(), pa.int64())], ["host", "layout", "node", "sign", "chars", "n"])

    texts = fed.mapInArrow(run, "host string, layout long, node int, sign long, chars long, n long")
    each = texts.groupBy("host", "layout", "node", "sign").agg(F.sum("n").alias("n"), F.sum(F.col("chars") * F.col("n")).alias("chars"))
    top = F.max(F.when(F.col("sign") != 0, F.struct("n", "sign", "chars")))
    seen = each.groupBy("host", "layout", "node").agg(F.sum("n").alias("pages"), top.alias("top"), F.sum("chars").alias("chars"))
    one = F.struct("node", "pages", F.coalesce("top.sign", F.lit(0)).alias("sign"), F.coalesce("top.n", F.lit(0)).alias("same"), F.coalesce("top.chars", F.lit(0)).alias("same_chars"), "chars")
    # as many rows as the reference has nodes
    stats = seen.groupBy("host", "layout").agg(F.collect_list(one).alias("seen"))
    return hosts, work.save(listed.join(stats, ["host", "layout"]), "wrappers")


def _with_wrappers(pages: DataFrame, hosts: DataFrame, wrappers: DataFrame) -> DataFrame:
    """pages with host, layout, own and the columns of wrappers(host, layout, reference, ...), null without one; own: the wrapper is of the page's layout."""
    size = wrappers.agg(F.max(F.octet_length("reference"))).first()[0] or 0
    rows = pages.withColumn("host", host_of(F.col("url"))).join(broadcast_if_small(hosts, 256), "host", "left")
    if hosts.filter("many").limit(1).count():
        # where a host has one layout, its pages are not parsed for it
        rows = rows.withColumn("layout", layout_of(F.when(F.col("many"), F.col("html"))))
        named = wrappers.select("host", "layout", F.lit(True).alias("own")).join(broadcast_if_small(hosts.filter("many").select("host"), 256), "host", "left_semi")
        rows = rows.join(broadcast_if_small(named, 256), ["host", "layout"], "left")
        rows = rows.withColumns({"layout": F.when(F.col("own"), F.col("layout")).otherwise(F.col("main")), "own": F.col("own").isNotNull() | ~F.col("many")})
    else:
        rows = rows.withColumns({"layout": F.col("main"), "own": F.lit(True)})
    return rows.drop("main", "many").join(broadcast_if_small(wrappers, size * 2 + 256), ["host", "layout"], "left")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages(page_id, url, html)."""
    work = Workspace(pages.sparkSession, "wrapper")
    pages = pages.select("page_id", "url", "html")
    fed = _with_wrappers(pages, *induce_wrappers(pages, work)).select("page_id", "url", "html", "reference", "seen", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[str, Wrapper | None] = {}
        for batch in batches:
            out = []
            for page, text, seen, own in zip(*(batch.column(c).to_pylist() for c in ("html", "reference", "seen", "own"))):
                wrapper = None
                if text is not None and page:
                    if text not in loaded:
                        if len(loaded) >= 100:
                            loaded.clear()
                        loaded[text] = load_wrapper(text, [tuple(x.values()) for x in seen])
                    wrapper = loaded[text]
                out.append(extract(page, wrapper, own))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return fed.mapInArrow(run, "page_id long, url string, text string, n_chars long")
