"""HTML extraction by equivalence-class template deduction.

Pages of a host are dealt into blocks of about ``block_chars`` characters and at most about ``block_pages`` pages by a
hash of the row, so that a host or a page with a third of all rows makes many bounded groups. In each block:

1. A page becomes tokens: tags with their path of open elements and texts with theirs (the roles). A text runs
   over inline elements to the next tag of a block. Pages with equal candidate text count once.
2. A role's occurrence vector counts it on every page of the block. Roles of three pages or more with equal
   vectors form a class. A class is valid if its tokens come in one order, again and again, on every page (else
   its parts inside single elements are tried), and if no other class cuts through it, so that classes nest. A
   text is a class of its own if its class is not valid.
3. The slots of the template are named by the path of those open elements that belong to valid classes. A text
   of the template is shared if it stands on most pages that have its slot, and a slot recurs if on most of its
   pages all its texts stand on three pages or more; other slots vary.
4. Pages with an article or main element: its text is main text, unless it stands inside an element whose name, class,
   id or role hints at menus, headers, notices, adverts and the like and is shared or in a slot that recurs.
   Pages without one: all text of the body that is not shared is main text. Under a hint, text of slots that
   recur goes too, and under an element named by nothing but hints all text does whose slot is not seen to vary.
   Menus, forms, scripts and comment blocks never are main text, nor footers and asides outside a main element.
5. The main texts are put out block by block.

Character references are decoded, white space inside a block becomes one space, blocks are joined by an empty
line. Text in a main element without a hint is never treated as template, even if all pages share it, as title
and parts of articles may.

Defined cases: null and empty pages give an empty text; unclosed elements end with their parents; a null url is
a host of its own; a page alone in its block is its own template; rows that are repeated in full share a block and
give repeated results; very long pages are read whole; columns of the input that clash with the added ones are
replaced; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import materialize, small, without, workers

# Fixed values of HTML: elements by how they behave.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rb", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSED_BY_SELF = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "p": {"td", "th", "li", "div", "article", "section", "body"}, "option": {"select"}}
# Elements that hold no main text, and those that hold none outside a main element.
NO_TEXT = {"head", "nav", "form", "button", "select", "textarea", "label", "script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "dialog", "menu", "title"}
PAGE_ENDS = {"footer", "aside"}
# Words in a class, id or role that hint at no main text, and those that name parts of a comment block.
NO_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies", "consent", "notice", "notices", "notification", "alert", "newsletter", "subscribe", "signup", "popup", "modal", "sidebar", "widget", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "share", "sharing", "social", "related", "recommended", "login", "search", "comment", "comments", "disqus", "reply", "replies", "respond"}
COMMENT_WORDS = {"comment", "comments", "disqus", "reply", "replies", "respond"}
COMMENT_PARTS = COMMENT_WORDS | {"area", "author", "block", "body", "box", "container", "content", "form", "item", "list", "post", "section", "thread", "user", "wrapper"}
MAIN = {"article", "main"}
# Characters of pages for a task; there are as many tasks as that takes, at least Spark's number of shuffle partitions.
TASK_CHARS = 32 << 20
# Pages that must hold a token before it is part of a template.
SUPPORT = 3

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea|title|noscript|iframe|xmp)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
MARKED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def _marks(rest: str) -> frozenset[tuple[str, ...]]:
    """The words of each class, id and role."""
    tokens = (t for m in MARKED.findall(rest) for t in "".join(m).lower().split())
    return frozenset(w for t in tokens if (w := tuple(x for x in re.split(r"[^a-z]+", t) if x)))


class Tree:
    """The paths of open elements on the pages of a block; a path is a number, and parents come before children."""

    def __init__(self):
        self.parent, self.name, self.marks = [-1], ["html"], [frozenset()]
        self.soft, self.inline = [False], [False]
        self.known: dict[tuple, int] = {}
        self.marked: dict[str, frozenset] = {"": frozenset()}

    def child(self, parent: int, name: str, rest: str) -> int:
        marks = self.marked.get(rest)
        if marks is None:
            marks = self.marked[rest] = _marks(rest)
        node = self.known.setdefault((parent, name, marks), len(self.parent))
        if node == len(self.parent):
            self.parent.append(parent)
            self.name.append(name)
            self.marks.append(marks)
            self.soft.append(name not in ("html", "body") and not self.is_main(node) and (name == "header" or name in PAGE_ENDS or any(w in NO_WORDS for m in marks for w in m)))
            self.inline.append(name in INLINE and not self.soft[node])
        return node

    def is_comment(self, node: int) -> bool:
        return any(not COMMENT_WORDS.isdisjoint(m) and COMMENT_PARTS.issuperset(m) for m in self.marks[node])

    def is_main(self, node: int) -> bool:
        name = self.name[node]
        return (name in MAIN or name in ("div", "section") and any("main" in m for m in self.marks[node])) and not self.is_comment(node)

    def is_strong(self, node: int) -> bool:
        """Whether nothing but such words stand in a class, id or role, or the element is a header."""
        return self.name[node] == "header" or any(NO_WORDS.issuperset(m) for m in self.marks[node])


class Page:
    """A page's roles in order, and its blocks: lists of (place, text), a place being the nearest block or marked element."""

    def __init__(self, source: str, tree: Tree, texts: dict[tuple[int, str], int]):
        self.roles: list[int] = []  # 2 * node opens, 2 * node + 1 closes, -1 - n is text n
        self.blocks: list[list[tuple[int, str, int]]] = []
        self.nodes: set[int] = set()
        self.now: list[tuple[int, str]] = []
        self.tree, self.texts = tree, texts
        path = [0]
        place = [0]
        names = ["html"]
        at = 0
        for m in TOKEN.finditer(source):
            if m.start() > at:
                self.now.append((place[-1], html.unescape(source[at : m.start()])))
            at = m.end()
            name = m["name"]
            if not name:
                continue
            name = name.lower()
            if m["end"]:
                if name not in INLINE:
                    self._close()
                for k in range(len(names) - 1, 0, -1):
                    if names[k] == name:
                        if not tree.inline[path[k]]:
                            self.roles.append(2 * path[k] + 1)
                        del path[k:], place[k:], names[k:]
                        break
                continue
            if name == "br":
                self.now.append((place[-1], " "))
                continue
            if name not in INLINE:
                self._close()
            for closed in ({"p"} if name in ENDS_P else set()) | ({name} & CLOSED_BY_SELF):
                for k in range(len(names) - 1, 0, -1):
                    if names[k] == closed:
                        del path[k:], place[k:], names[k:]
                        break
                    if names[k] in SCOPES.get(closed, ()):
                        break
            node = tree.child(path[-1], name, m["rest"])
            self.nodes.add(node)
            if not tree.inline[node]:
                self.roles.append(2 * node)
            if name not in VOID:
                path.append(node)
                place.append(place[-1] if tree.inline[node] else node)
                names.append(name)
        if at < len(source):
            self.now.append((place[-1], html.unescape(source[at:])))
        self._close()

    def _close(self) -> None:
        if not self.now:
            return
        whole: dict[int, list[str]] = {}
        for place, text in self.now:
            whole.setdefault(place, []).append(text)
        number = {}
        for place, parts in whole.items():
            if text := " ".join("".join(parts).split()):
                number[place] = self.texts.setdefault((place, text), len(self.texts))
                self.roles.append(-1 - number[place])
        if number:
            self.blocks.append([(place, text, number.get(place, -1)) for place, text in self.now])
        self.now = []


def _ordered(roles: set[int], sequences: list[list[int]]) -> list[int] | None:
    """The one order in which the roles come, again and again, on every page; None if there is no such order."""
    order: list[int] = []
    for sequence in sequences:
        own = [r for r in sequence if r in roles]
        order = order or own[: len(roles)]
        if len(own) % len(order) or any(r != order[k % len(order)] for k, r in enumerate(own)):
            return None
    return order if len(set(order)) == len(roles) else None


def deduce(sequences: list[list[int]], parent: Callable[[int], int]) -> set[int]:
    """The roles of the valid equivalence classes: those that come in one order and nest."""
    vectors: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, roles in enumerate(sequences):
        for role, n in Counter(roles).items():
            vectors[role].append((i, n))
    classes: dict[tuple, set[int]] = defaultdict(set)
    for role, vector in vectors.items():
        if len(vector) >= SUPPORT:
            classes[tuple(vector)].add(role)
    sequences = [[r for r in roles if len(vectors[r]) >= SUPPORT] for roles in sequences]
    cycles: list[list[int]] = []
    for vector, roles in classes.items():
        own = [sequences[i] for i, _ in vector]
        if order := _ordered(roles, own):
            cycles.append(order)
            continue
        parts: dict[int, set[int]] = defaultdict(set)  # what has no order as a whole may have one inside an element
        for role in roles:
            parts[parent(role)].add(role)
        for part in parts.values():
            order = _ordered(part, own)
            cycles.extend([order] if order else [[r] for r in part if r < 0])
    place = {role: (c, k) for c, order in enumerate(cycles) for k, role in enumerate(order)}
    broken: set[int] = set()
    for roles in sequences:
        open_: list[int] = []
        for role in roles:
            c, k = place.get(role, (-1, 0))
            if c < 0 or c in broken:
                continue
            if k == 0:
                open_.append(c)
            elif c in open_:
                while open_[-1] != c:  # a class that another one cuts through
                    broken.add(open_.pop())
            if k == len(cycles[c]) - 1 and c in open_:
                while open_.pop() != c:
                    pass
    return {role for c, order in enumerate(cycles) for role in order if c not in broken or role < 0}


class Template:
    """The slots of a block's template, and which texts of which slots are main text."""

    def __init__(self, tree: Tree, pages: list[Page], texts: dict[tuple[int, str], int]):
        self.tree = tree
        size = len(tree.parent)
        wraps: set[int] = set()  # an element around a main element is a wrapper, whatever its class says
        self.mains = {n for n in range(size) if tree.is_main(n)}
        for n in self.mains:
            while (n := tree.parent[n]) >= 0:
                wraps.add(n)
        self.inside, self.never, self.soft = ([False] * size for _ in range(3))
        self.strong = [0] * size  # the outermost such element, 0 for none
        for n in range(1, size):
            up = tree.parent[n]
            free = n in wraps or n in self.mains or tree.name[n] in ("html", "body")
            self.inside[n] = self.inside[up] or n in self.mains
            self.never[n] = self.never[up] or not free and (tree.name[n] in NO_TEXT or tree.is_comment(n) or tree.name[n] in PAGE_ENDS and not self.inside[n])
            self.soft[n] = self.soft[up] or not free and tree.soft[n]
            self.strong[n] = self.strong[up] or (n if not free and tree.soft[n] and tree.is_strong(n) else 0)
        once: dict[tuple, Page] = {}  # copies of an article are one page
        for page in pages:
            inside = not self.mains.isdisjoint(page.nodes)
            key = tuple(t for block in page.blocks for t in {t: 0 for n, _, t in block if t >= 0 and not self.never[n] and (self.inside[n] or not inside)})
            once.setdefault(key, page)
        distinct = list(once.values())
        where = [n for n, _ in texts]
        template = deduce([p.roles for p in distinct], lambda r: where[-1 - r] if r < 0 else tree.parent[r >> 1])
        # a slot is named by the template's elements that are open there
        names: dict[tuple, int] = {}
        slot = [0] * size
        for n in range(1, size):
            up = slot[tree.parent[n]]
            slot[n] = names.setdefault((up, tree.name[n], tree.marks[n]), len(names) + 1) if 2 * n in template else up
        at = [(slot[n], text) for n, text in texts]
        held: Counter = Counter()
        seen: Counter = Counter()
        own = [{at[-1 - r] for r in p.roles if r < 0} for p in distinct]
        for of_page in own:
            seen.update(of_page)
            held.update({s for s, _ in of_page})
        again: Counter = Counter()
        for of_page in own:
            again.update({s for s, _ in of_page} - {x[0] for x in of_page if seen[x] < SUPPORT})
        self.shared = [-1 - t in template and 2 * seen[x] > held[x[0]] for t, x in enumerate(at)]
        self.recurs = [-1 - t in template and 2 * again[x[0]] > held[x[0]] for t, x in enumerate(at)]
        apart = lambda n: slot[n] != slot[tree.parent[self.strong[n]]]
        self.varies = [bool(self.strong[n]) and apart(n) and held[slot[n]] >= SUPPORT and 2 * again[slot[n]] <= held[slot[n]] for n in range(size)]

    def keeps(self, inside: bool, place: int, text: int) -> bool:
        """Whether a text is main text, on a page with or without a main element."""
        if self.never[place] or inside and not self.inside[place]:
            return False
        if inside:
            return not (self.soft[place] and (self.shared[text] or self.recurs[text]))
        if self.shared[text] or self.soft[place] and self.recurs[text]:
            return False
        return not self.strong[place] or self.varies[place]

    def render(self, page: Page) -> str:
        inside = not self.mains.isdisjoint(page.nodes)
        blocks = []
        for block in page.blocks:
            good = {n: self.keeps(inside, n, t) for n, _, t in block if t >= 0}
            if text := " ".join("".join(x for n, x, t in block if t < 0 or good[n]).split()):
                blocks.append(text)
        return "\n\n".join(blocks)


def extract_block(sources: list[str | None]) -> list[str]:
    tree, texts = Tree(), {}
    pages = [Page(s or "", tree, texts) for s in sources]
    template = Template(tree, pages, texts)
    return [template.render(page) for page in pages]


def extract(pages: DataFrame, *, page_html: str = "html", url: str = "url", block_chars: int = 1 << 20, block_pages: int = 256) -> DataFrame:
    """``pages`` without ``html`` but with text and n_chars."""
    rows = without(pages, "text", "n_chars", "__host", "__block")
    rows = rows.withColumn("__host", F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))))
    chars = F.sum(F.coalesce(F.length(page_html), F.lit(0)))
    hosts = rows.groupBy(F.col("__host").alias("h")).agg(chars.alias("chars"), F.greatest(F.ceil(chars / block_chars), F.ceil(F.count(F.lit(1)) / block_pages)).alias("n"))
    hosts = materialize(hosts)
    total = hosts.agg(F.sum("chars")).first()[0] or 0
    # all columns decide the block, so copies of a page under other ids are spread
    dealt = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns if c != "__host"])
    rows = rows.join(small(hosts, 100_000), F.col("__host") == F.col("h")).withColumn("__block", F.pmod(dealt, F.greatest(F.col("n"), F.lit(1)))).drop("h", "chars", "n")
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_CHARS))
    rows = rows.repartition(tasks, "__host", "__block")
    keep = [c for c in rows.columns if c not in (page_html, "__host", "__block")]
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def work(group: pa.Table) -> pa.Table:
        texts = extract_block(group.column(page_html).to_pylist())
        columns = [group.column(c) for c in keep]
        return pa.Table.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[f.name for f in schema.fields])

    return workers(rows).groupBy("__host", "__block").applyInArrow(work, schema)
