"""Main text of HTML pages by minimum-cut labelling.

A page becomes blocks: the text between block-level tags, references decoded, white space as single spaces. A
classifier scores each block from where it stands (containers by tag, class, id and role), its link density, its
length and its punctuation; the score is the capacity of its edge to one of the two terminals. Neighbouring blocks,
more so within one parent, and blocks of one container are tied by smoothness edges. The minimum cut separates
content from the rest. A block whose score outweighs its edges is on that side of every minimum cut, so it is fixed
first and its edges become its neighbours' terminal capacities; the flow is computed on what is left, by level graphs.

Null and empty html give an empty text. Unclosed tags, quotes and comments end where the page ends. A page without
blocks of content has an empty text. Repeated rows give repeated rows; extra columns pass through, but for those named
text and n_chars, which are replaced.
"""

from __future__ import annotations

import re
from collections import deque
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from waymark.llm.common import table

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
#: HTML's tag names by how they are read.
SKIPPED = frozenset("script style noscript template svg iframe object canvas math textarea select option title head datalist audio video".split())
RAW = frozenset("script style textarea title iframe noscript".split())
BLOCKS = frozenset("address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
CONTENT = frozenset("article main".split())
CHROME = frozenset("nav header footer aside form menu dialog button search fieldset".split())
ASIDE = frozenset("nav header footer aside dialog".split())
#: Those that some site builders put around the whole page.
AROUND = frozenset("form fieldset".split())
#: Words of class, id and role that name what is not the article, or is.
OTHER_WORD = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|header|masthead|footer|foot|sidebar|side|aside|widget\w*|cookie\w*|consent|notice|alert|popup|modal|comment(?!ar)\w*|disqus|replies|reply|responses|discussion|share|sharing|social|related|recommend\w*|breadcrumbs?|pager|pagination|login|signup|subscribe|newsletter|search|form|toolbar|copyright|legal|contentinfo|navigation|complementary|tags?)(?:$|[\s_-])", re.I)
#: Those that name a discussion or other pages' teasers, which can hold articles of their own.
APART_WORD = re.compile(r"(?:^|[\s_-])(?:comment(?!ar)\w*|disqus|replies|reply|responses|discussion|related|recommend\w*)(?:$|[\s_-])", re.I)
#: Names are split where a capital begins a word.
CAPITAL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: A name such as has-sidebar tells what stands beside the content.
BESIDE = re.compile(r"(?:^|(?<=[\s_-]))(?:has|with|without|no)[_-][^\s_-]+", re.I)
WHOLE = ("html", "body", "article", "main")
CONTENT_WORD = re.compile(r"(?:^|[\s_-])(?:article|main|content|post|entry|story|body|text)(?:$|[\s_-])", re.I)

#: Costs of where a block stands, near those of its text (at most 2.5), and of edges; so edges decide where these disagree.
STANDS_INSIDE, STANDS_OUT = 2.5, 4.0
#: What a block of links alone costs; an article may hold lists of links of its own.
LINKED, LINKED_WITHIN = 4.0, 1.0
NEAR_SAME, NEAR_OTHER, SAME_CONTAINER = 1.0, 0.25, 0.25


class Block:
    __slots__ = ("text", "parent", "container", "inside", "within", "out", "links", "head")

    def __init__(self, text, parent, container, links, head):
        self.text, self.parent, self.container, self.links, self.head = text, parent, container, links, head
        self.inside = self.within = self.out = 0  # content by tag, role or name; an article or main; not content

    def score(self) -> float:
        """Above zero: content."""
        n = len(self.text)
        s = -0.5 + min(2.0, n / 100) + (0.5 if self.text[-1] in ".!?…:;" else 0.0) - (LINKED_WITHIN if self.within else LINKED) * min(1.0, self.links / max(n, 1))
        return s + 0.5 * self.head - (STANDS_OUT if self.out else -STANDS_INSIDE * self.inside)


def blocks(html: str) -> list[Block]:
    found: list[Block] = []
    stack: list[tuple] = [("", 0, 0)]  # tag, id, container's id
    nodes: list[tuple] = [("", 0, False, "", False)]  # of each id: tag, id above, not shown, names, role of content
    at, ids, parts, links, in_link = 0, 0, [], 0, 0
    unclosed: set[str] = set()  # skipped tags that are not closed in the rest of the page

    def flush():
        nonlocal parts, links
        if parts:
            if text := " ".join(unescape("".join(parts)).split()):
                tag, me, container = stack[-1]
                found.append(Block(text, me, container, links, tag[:1] == "h" and tag[1:].isdigit()))
            parts = []
        links = 0

    while at < len(html):
        m = TOKEN.search(html, at)
        if (m.start() if m else len(html)) > at:
            piece = html[at : m.start() if m else len(html)]
            parts.append(piece)
            if in_link:
                links += len(piece.strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            elif tag in BLOCKS:
                flush()
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        in_link = 0
                        break
            continue
        if tag in SKIPPED:
            if tag in RAW or tag == "head":
                if tag == "head":
                    end = re.compile(r"</head\s*>|<body", re.I).search(html, at)
                    at = at if not end else end.start()
                else:
                    end = re.compile(rf"</{tag}[^>]*>", re.I).search(html, at)
                    at = end.end() if end else len(html)
            elif not m[0].endswith("/>") and tag not in unclosed:
                end = re.compile(rf"</{tag}[^>]*>", re.I).search(html, at)
                if end:
                    at = end.end()
                else:
                    unclosed.add(tag)
            continue
        if tag == "a":
            in_link += 1
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCKS:
            flush()
            if tag not in VOID:
                if stack[-1][0] == "p" or (tag == "li" and stack[-1][0] == "li"):
                    del stack[-1]
                ids += 1
                _, above, container = stack[-1]
                marks = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(m[3] or m[6] or "")}
                names = CAPITAL.sub("-", " ".join(marks.get(k, "") for k in ("class", "id", "role")))
                hidden = "hidden" in marks or marks.get("aria-hidden") == "true" or "display:none" in marks.get("style", "").replace(" ", "")
                nodes.append((tag, above, hidden, names, marks.get("role") in CONTENT))
                stack.append((tag, ids, ids if tag not in ("p", "li") and not re.match(r"h\d$", tag) else container))
    flush()
    placed(found, nodes)
    return found


def placed(found: list[Block], nodes: list[tuple]) -> None:
    """Sets what each block is inside of, and what above it is not content. A name counts against all that its container
    holds, but never on html, body, an article or main, on what holds the page's article (its main, or the first article
    that is in no other and in nothing apart or aside), or, unless it names a discussion or teasers, on what holds any article or most of the text; an
    article ends such a name's effect. A form around the page's article, or around most of a page without one, is no
    form block."""
    size, holds = [0] * len(nodes), [False] * len(nodes)
    for b in found:
        size[b.parent] += len(b.text)
    for i in range(len(nodes) - 1, 0, -1):
        tag, above, *_ = nodes[i]
        holds[i] = holds[i] or tag in CONTENT
        holds[above] = holds[above] or holds[i]
        size[above] += size[i]
    page, chain = 0, set()
    shut = [False] * len(nodes)  # apart, aside or in another article
    for i, (tag, above, _, names, _) in enumerate(nodes[1:], 1):
        shut[i] = shut[above] or tag in ASIDE or (tag not in WHOLE[:2] and bool(APART_WORD.search(BESIDE.sub("", names)))) or nodes[above][0] == "article"
        if (tag == "main" and (nodes[page][0] != "main" or size[i] > size[page])) or (not page and tag == "article" and not shut[i] and size[i]):
            page = i
    while page:
        chain.add(page)
        page = nodes[page][1]
    at = [(0, 0, False, False, False)]  # inside content, in an article or main, not content by tag or hidden, by a name, by a name of things apart
    for i, (tag, above, hidden, names, role) in enumerate(nodes[1:], 1):
        inside, within, out, named, apart = at[above]
        names = BESIDE.sub("", names)
        mine = tag not in WHOLE and i not in chain
        other_apart = mine and bool(APART_WORD.search(names))
        other_named = mine and not holds[i] and size[i] * 2 <= size[0] and bool(OTHER_WORD.search(names))
        around = tag in AROUND and (i in chain or holds[i] or (not chain and size[i] * 2 > size[0]))
        chrome = tag in CHROME and not around and not (tag == "header" and inside)
        other = hidden or chrome or other_named or other_apart
        good = tag in CONTENT or role or bool(CONTENT_WORD.search(names))
        named = (named and tag not in CONTENT) or other_named
        at.append((1 if good and not other else inside, int(within or tag in CONTENT or role), out or hidden or chrome, named, apart or other_apart))
    for b in found:
        b.inside, b.within, *out = at[b.parent]
        b.out = int(any(out))


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: source side) of a minimum cut with terminal capacities |score| and undirected edges."""
    n = len(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        if i != j:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    s, label = list(scores), [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(s[i]) >= sum(near[i].values()):
            label[i] = s[i] > 0
            for j, w in near[i].items():
                s[j] += w if label[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    content = source_side(s, [None if label[i] is not None else x for i, x in enumerate(near)])
    return [content[i] if x is None else x for i, x in enumerate(label)]


def source_side(s: list[float], near: list[dict[int, float] | None]) -> list[bool]:
    """Which nodes the source reaches once the flow is at its maximum. Nodes above zero get what they have from the source,
    those below pass theirs to the sink; near are the room of the edges, None for nodes that take no part. In each phase
    levels are the distances from the nodes that have something left, and paths go down levels only."""
    n = len(s)
    have, want = [max(x, 0.0) for x in s], [max(-x, 0.0) for x in s]
    room = [None if x is None else dict(x) for x in near]
    order = [None if x is None else list(x) for x in near]
    least = 1e-9
    while True:
        level = [-1] * n
        queue = [i for i in range(n) if room[i] is not None and have[i] > least]
        for i in queue:
            level[i] = 0
        met = False
        for u in queue:
            met = met or want[u] > least
            for v, c in room[u].items():
                if c > least and level[v] < 0:
                    level[v] = level[u] + 1
                    queue.append(v)
        if not met:
            return [x >= 0 for x in level]
        at = [0] * n  # the neighbours before are of no more use in this phase
        for start in [i for i in queue if not level[i]]:
            path = [start]
            while path and have[start] > least:
                u = path[-1]
                if want[u] > least:
                    flow = min(have[start], want[u], *(room[x][y] for x, y in zip(path, path[1:])))
                    have[start] -= flow
                    want[u] -= flow
                    for x, y in zip(path, path[1:]):
                        room[x][y] -= flow
                        room[y][x] += flow
                    cut = next((k for k, (x, y) in enumerate(zip(path, path[1:])) if room[x][y] <= least), None)
                    if cut is not None:
                        del path[cut + 1 :]
                    continue
                while at[u] < len(order[u]):
                    v = order[u][at[u]]
                    if level[v] == level[u] + 1 and room[u][v] > least:
                        path.append(v)
                        break
                    at[u] += 1
                else:
                    path.pop()
                    if path:
                        at[path[-1]] += 1


def main_text(html: str | None) -> str:
    found = blocks(html or "")
    if not found:
        return ""
    edges = [(i, i + 1, NEAR_SAME if a.parent == b.parent or a.container == b.container else NEAR_OTHER) for i, (a, b) in enumerate(zip(found, found[1:]))]
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if b.container in last and last[b.container] < i - 1:
            edges.append((last[b.container], i, SAME_CONTAINER))
        last[b.container] = i
    keep = min_cut([b.score() for b in found], edges)
    return "\n".join(b.text for b, k in zip(found, keep) if k)


def extracted(pages: DataFrame) -> DataFrame:
    """pages with text in place of html, and n_chars; columns of those names are replaced."""

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            rest = [c for c in batch.schema.names if c not in ("html", "text", "n_chars")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*rest, "text", "n_chars"])

    rest = [f for f in pages.schema.fields if f.name not in ("html", "text", "n_chars")]
    return pages.mapInArrow(run, T.StructType([*rest, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))


def op6_html_text(spark, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
