"""Random pages as trees: the tree is the answer's source, its rendering is what the operator reads."""

import math
import random
import re

from siftwell.llm.html import main_text

BLOCKS = {"body", "div", "section", "article", "main", "p", "ul", "li", "h2", "blockquote", "nav", "aside", "footer", "header"}
NEVER = {"nav", "aside", "footer"}


class Node:
    def __init__(self, tag, attrs="", kids=()):
        self.tag, self.attrs, self.kids = tag, attrs, list(kids)

    def html(self):
        inner = "".join(k.html() if isinstance(k, Node) else k.replace("&", "&amp;").replace("<", "&lt;") for k in self.kids)
        return f"<{self.tag}{self.attrs}>{inner}</{self.tag}>"


def words(rng, most):
    return rng.choice(["", " ", "\n"]).join(["", " ".join(rng.choice(["word", "a", "R&D", "x<y", "long-ish", "é", "sentence."]) for _ in range(rng.randrange(1, most)))]) + rng.choice(["", " ", "\n "])


def inline(rng, linked=False):
    out = []
    for _ in range(rng.randrange(1, 4)):
        x = rng.random()
        if x < 0.6:
            out.append(words(rng, 25))
        elif x < 0.8 and not linked:
            out.append(Node("a", ' href="/hidden/ad"', inline(rng, True)))
        else:
            out.append(Node(rng.choice(["b", "i", "span"]), rng.choice(["", "", ' class="ad"', " hidden"]), [words(rng, 8)]))
    return out


def block(rng, depth):
    x = rng.random()
    if depth == 0 or x < 0.35:
        return Node("p", rng.choice(["", "", "", ' class="notice"']), inline(rng))
    if x < 0.45:
        return Node("h2", rng.choice(["", ' id="related"']), [words(rng, 6)])
    if x < 0.55:
        return Node("ul", "", [Node("li", "", inline(rng)) for _ in range(rng.randrange(1, 4))])
    if x < 0.65:
        return Node(rng.choice(["nav", "aside", "footer", "header"]), "", [block(rng, depth - 1)])
    tag = rng.choice(["div", "div", "div", "section", "article", "main", "blockquote"])
    attrs = rng.choice(["", "", "", ' class="ad"', ' id="social"', ' class="text"', ' style="display:none"'])
    return Node(tag, attrs, [block(rng, depth - 1) if rng.random() < 0.85 else words(rng, 30) for _ in range(rng.randrange(1, 5))])


def brute(body):
    order, up = [], {}

    def walk(node, parent, gone, linked, within):
        named = re.search(r'(class|id)="(ad|notice|related|social)"', node.attrs)
        if named:
            text = node.tag in ("p", "h2", "blockquote", "ul", "li") and node.tag != "ul"
            named = not (within and (text or node.tag == "section" and named[1] == "id"))
        if node.tag in ("article", "main"):
            named = False
        shown = node.tag in ("article", "main") or " hidden" not in node.attrs.split('"')[0] and "display:none" not in node.attrs
        node.gone = gone or node.tag in NEVER or node.tag == "header" and not within or bool(named) or not shown
        node.linked = linked or node.tag == "a"
        node.at, up[node] = len(order), parent
        order.append(node)
        for k in node.kids:
            if isinstance(k, Node):
                walk(k, node, node.gone, node.linked, within or node.tag in ("article", "main"))

    walk(body, None, False, False, False)
    live = [n for n in order if not n.gone]

    def above(n):
        out = [n]
        while up[out[-1]] is not None:
            out.append(up[out[-1]])
        return out

    def under(n):
        return [x for x in live if n in above(x)]

    def size(x):
        return sum(len(re.sub("[ \n]", "", k)) for k in x.kids if isinstance(k, str))

    c = {n: sum(size(x) for x in under(n)) for n in live}
    if not c[body]:
        return ""
    links = {n: sum(size(x) for x in under(n) if x.linked) for n in live}
    ratio = links[body] / c[body]
    density = {}
    for n in live:
        inside = [x for x in under(n) if x is not n]
        t, lt = max(1, len(inside)), max(1, sum(x.tag == "a" for x in inside))
        base = math.log(c[n] / max(1, c[n] - links[n]) * links[n] + ratio * c[n] + math.e) + math.e - 1
        density[n] = c[n] / t * math.log(max(math.e, c[n] / max(1, links[n]) * t / lt), base) if c[n] else 0.0
    total = {n: sum(density[k] for k in reversed(n.kids) if isinstance(k, Node) and not k.gone) for n in live}

    def best(n):
        # sums are added in another order than the operator's, so equal ones are told by rounding
        return max(under(n), key=lambda x: (round(total[x], 7), -x.at))

    core = best(body)
    threshold = min(density[x] for x in above(core))
    picked = [core] + [best(k) for k in body.kids if isinstance(k, Node) and not k.gone and c[k] and density[k] >= threshold]
    common = set(above(core)).intersection(*map(above, picked))
    top = max(common, key=lambda x: len(above(x)))
    top = next((x for x in reversed(above(top)) if x.tag in ("article", "main")), top)
    out = [""]

    def read(n):
        if n.tag in BLOCKS:
            out.append("")
        for k in n.kids:
            if isinstance(k, Node):
                read(k)
            elif not n.gone and top in above(n):
                out[-1] += k
        if n.tag in BLOCKS:
            out.append("")

    read(body)
    return "\n\n".join(x for x in (" ".join(y.split()) for y in out) if x)


def test_random_pages_equal_brute_force():
    rng = random.Random(9)
    some = 0
    for _ in range(600):
        body = Node("body", "", [block(rng, rng.randrange(1, 5)) for _ in range(rng.randrange(1, 6))])
        want = brute(body)
        assert main_text(f"<!DOCTYPE html><html><head><title>T</title></head>{body.html()}</html>") == want, body.html()
        some += bool(want)
    assert some > 400
