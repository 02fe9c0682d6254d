"""Main text of web pages by composite text density.

A tolerant scanner builds the page's tree (void elements, raw text, implied end tags; a cut-off page ends
where it ends). Structural boilerplate (menus, forms, scripts, asides, elements whose class, id or role says
advert, comment, cookie and the like) is taken out; inside article or main, the class and id of headings and text blocks, and the id of sections,
are names of the text and take nothing out. For every node that is left, the density is characters
per tag, adjusted by the share of characters and tags that are links; a node's density sum adds its
children's densities. The node of the largest sum is the core; the lowest density on its path to the body is the
threshold; every child along the top whose density reaches it adds its own core. The result is the smallest
subtree that holds all cores, widened to the article or main element around them, so that short blocks
between long ones stay.

Defined cases: null or empty html, and a page without text outside boilerplate, give an empty text; equal
density sums go to the earlier node; rows are judged one by one; an empty table gives an empty result.
Time and memory are linear in the page: the tree is arrays in page order, read without recursion.
"""

from __future__ import annotations

import heapq
import math
import re
from html import unescape

from pyspark.sql import DataFrame

from siftwell.llm.common import map_rows, require, table

TOKEN = re.compile(r"<!--|<!|<\?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>?")
#: Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag ends these open elements of the same parent.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPE = frozenset("table ul ol dl select body html article section div main".split())
DROP = frozenset("nav footer aside form button select dialog menu head script style noscript template iframe svg math textarea title object canvas audio video datalist input xmp noframes".split())
DROP_ROLE = re.compile(r"\b(?:navigation|banner|contentinfo|complementary|search|form|dialog|alert|menu|menubar)\b")
DROP_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|adslot|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|comments?|commentlist|disqus|replies|respond|sidebar|side|menu|navbar|nav|navigation|breadcrumbs?|footer|header|masthead|topbar|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|pagination|pager|toolbar|widget\w*|tags|hidden)(?=$|[\s_-])",
    re.I,
)
#: One attribute after the other, as the HTML standard splits them: name and quoted or bare value.
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Headings and text blocks: inside article or main their class and id say what the text is about.
TEXT = frozenset("h1 h2 h3 h4 h5 h6 hgroup p blockquote pre dl dt dd li figure figcaption table caption thead tbody tfoot tr td th".split())
KEPT = frozenset("html body article main".split())
#: Elements at which the search for one to end may stop.
MARKS = SCOPE.union(*ENDS.values())
STOPS = BLOCK | {"button"}


class Tree:
    """Nodes in page order: tag, parent, dropped, and their own pieces of text as (node, order) runs."""

    def __init__(self, page: str):
        self.tag, self.parent, self.gone, self.within, self.runs = ["#root"], [-1], [False], [False], []
        stack, at, size = [0], 0, len(page)
        # open elements by name, and the places on the stack of open marks and stops, so that no search reads the whole stack
        self.count: dict[str, int] = {}
        self.marks: list[int] = []
        self.stops: list[int] = []
        while at < size:
            m = TOKEN.search(page, at)
            if not m:
                self.text(stack[-1], page[at:])
                break
            if m.start() > at:
                self.text(stack[-1], page[at : m.start()])
            at = m.end()
            if m[2] is None:
                close = "-->" if m[0] == "<!--" else ">"
                end = page.find(close, at)
                at = size if end < 0 else end + len(close)
                continue
            name = m[2].lower()
            if at and page[at - 1] != ">":  # an unclosed quote or the page's end
                end = page.find(">", at)
                at = size if end < 0 else end + 1
            if m[1]:
                if name == "br" or name == "p" and not self.count.get("p"):
                    self.runs.append((stack[-1], None if name == "p" else " "))
                    continue
                if self.count.get(name):
                    k = len(stack) - 1
                    while self.tag[stack[k]] != name:
                        k -= 1
                    self.close(stack, k)
                continue
            self.imply(stack, name)
            if name in VOID:
                if name in ("br", "hr"):
                    self.runs.append((stack[-1], " " if name == "br" else None))
                continue
            node = self.open(stack[-1], name, m[3])
            if name in RAW:
                end = re.compile(f"</{re.escape(name)}", re.I).search(page, at)
                at = size if not end else page.find(">", end.end()) + 1 or size
                continue
            if name in BLOCK:
                self.runs.append((node, None))
            if not m[3].rstrip().endswith("/") or name in BLOCK:
                self.count[name] = self.count.get(name, 0) + 1
                if name in MARKS:
                    self.marks.append(len(stack))
                if name in STOPS:
                    self.stops.append(len(stack))
                stack.append(node)

    def text(self, node: int, s: str) -> None:
        self.runs.append((node, unescape(s)))

    def open(self, parent: int, name: str, attrs: str) -> int:
        gone = self.gone[parent] or name in DROP
        if not gone and name == "header" and not self.within[parent]:
            gone = True
        if not gone and attrs and name not in KEPT:
            gone = self.says_boilerplate(name, attrs, self.within[parent])
        self.tag.append(name)
        self.parent.append(parent)
        self.gone.append(gone)
        self.within.append(self.within[parent] or name in ("article", "main"))
        return len(self.tag) - 1

    @staticmethod
    def says_boilerplate(name: str, attrs: str, within: bool) -> bool:
        has: dict[str, str] = {}
        for m in ATTRIBUTE.finditer(attrs):
            has.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")  # the first of a name counts
        names = [] if within and name in TEXT else ["class"] if within and name == "section" else ["class", "id"]
        if any(DROP_NAME.search(has.get(x, "")) for x in names) or DROP_ROLE.search(has.get("role", "").lower()):
            return True
        if has.get("hidden", "false").lower() != "false" or has.get("aria-hidden", "").lower() == "true":
            return True
        return bool(re.search(r"display\s*:\s*none", has.get("style", ""), re.I))

    def close(self, stack: list[int], k: int) -> None:
        if any(self.tag[i] in BLOCK for i in stack[k:]):
            self.runs.append((stack[k - 1], None))
        for i in stack[k:]:
            self.count[self.tag[i]] -= 1
        for places in (self.marks, self.stops):
            while places and places[-1] >= k:
                places.pop()
        del stack[k:]

    def imply(self, stack: list[int], name: str) -> None:
        if name in BLOCK and self.stops and self.tag[stack[self.stops[-1]]] == "p":
            self.close(stack, self.stops[-1])
        if name in ENDS:
            for i in range(len(self.marks) - 1, -1, -1):
                k = self.marks[i]
                t = self.tag[stack[k]]
                if t in ENDS[name]:
                    self.close(stack, k)
                    if name != "tbody" and t == name or t not in ("td", "th"):
                        break
                elif t in SCOPE:
                    break

    def core(self) -> int:
        """The node whose subtree is the main text; -1 if there is none."""
        n = len(self.tag)
        chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = self.tag[i] == "a" or in_link[self.parent[i]]
        for i, s in self.runs:
            if s and not self.gone[i]:
                c = len(s) - s.count(" ") - s.count("\n")
                chars[i] += c
                links[i] += c * in_link[i]
        for i in range(n - 1, 0, -1):
            if not self.gone[i]:
                p = self.parent[i]
                chars[p] += chars[i]
                links[p] += links[i]
                tags[p] += tags[i] + 1
                link_tags[p] += link_tags[i] + (self.tag[i] == "a")
        if not chars[0]:
            return -1
        body = next((i for i in range(n) if self.tag[i] == "body"), 0)
        body = body if chars[body] else 0
        ratio = links[body] / chars[body]
        density, sums = [0.0] * n, [0.0] * n
        for i in range(n):
            c, lc, t, lt = chars[i], links[i], max(1, tags[i]), max(1, link_tags[i])
            if c and not self.gone[i]:
                # the published base is a logarithm that is 1 without links; shifted to e there, so that it stays continuous
                base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e) + math.e - 1
                density[i] = c / t * math.log(max(math.e, c / max(1, lc) * t / lt), base)
        for i in range(1, n):
            sums[self.parent[i]] += density[i]
        best = list(range(n))  # the node of the largest sum in each subtree
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            if not self.gone[i] and sums[best[i]] > 0 and (sums[best[i]], -best[i]) > (sums[best[p]], -best[p]):
                best[p] = best[i]
        core = best[body]
        path, i = [], core
        while i > 0 and i != body:
            path.append(i)
            i = self.parent[i]
        threshold = min((density[i] for i in [*path, body]), default=0.0)
        picked = {core}
        for i in range(1, n):
            if self.parent[i] == body and not self.gone[i] and chars[i] and density[i] >= threshold:
                picked.add(best[i])
        up = self.common(picked)
        i = up
        while i > 0:
            if self.tag[i] in ("article", "main"):
                up = i
            i = self.parent[i]
        return up

    def common(self, nodes: set[int]) -> int:
        """Lowest node above all of them; nodes are in page order, so the largest goes up first."""
        known, heap = set(nodes), [-i for i in nodes]
        heapq.heapify(heap)
        while len(heap) > 1:
            p = self.parent[-heapq.heappop(heap)]
            if p not in known:
                known.add(p)
                heapq.heappush(heap, -p)
        return -heap[0]

    def blocks(self, top: int) -> list[str]:
        kept = [False] * len(self.tag)
        kept[top] = True
        for i in range(top + 1, len(self.tag)):
            kept[i] = kept[self.parent[i]] and not self.gone[i]
        out, now = [], []
        for i, s in self.runs:
            if s is None:
                if now:
                    out.append(" ".join("".join(now).split()))
                    now = []
            elif kept[i]:
                now.append(s)
        out.append(" ".join("".join(now).split()))
        return [x for x in out if x]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    tree = Tree(page)
    top = tree.core()
    return "" if top < 0 else "\n\n".join(tree.blocks(top))


def _row(page_id, url, page):
    text = main_text(page)
    return page_id, url, text, len(text)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    require(pages, "page_id", "url", "html")
    return map_rows(pages, "page_id long, url string, text string, n_chars long", _row, "page_id", "url", "html")


def op9_html(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
