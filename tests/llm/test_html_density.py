"""Operator 1: densities and closing of tags against plain versions, text that stands beside blocks, and time on unclosed tags."""

import math
import random
import time

import pytest

from lumenqa.llm import html_text as H

LONG = "<p>" + "some words of running text stand here " * 9 + "</p>"


def words(html):
    return H.main_text(html)


def test_strings_and_short_siblings_stay():
    whole = " ".join(LONG[3:-4].split())
    assert words(f"<body>INTRO bare text<br><br>SECOND bare run.<div>{LONG * 4}</div>TAIL</body>") == f"INTRO bare text SECOND bare run. {' '.join([whole] * 4)} TAIL"
    assert words(f"<div id=c>LEAD bare <b>bold</b> continuing<div>{LONG * 4}</div>TAIL</div>") == f"LEAD bare bold continuing {' '.join([whole] * 4)} TAIL"
    assert words(f"<h1>Title</h1><div>{LONG * 3}</div><p>Short end.</p>") == f"Title {' '.join([whole] * 3)} Short end."
    assert words(f"<div id=content><section>{LONG * 4}</section><section><p>One short sentence.</p></section></div>") == f"{' '.join([whole] * 4)} One short sentence."


def test_link_lists_and_bare_sparse_blocks_go():
    whole = " ".join([" ".join(LONG[3:-4].split())] * 3)
    menu = "<div><a href=x>Home</a> <a href=y>About</a> <a href=z>Contact</a></div>"
    more = "<div><ul><li><a href=1>one link</a></li><li><a href=2>two link</a></li></ul></div>"
    assert words(f"<body>{menu}<div>{LONG * 3}</div>{more}<div>Copyright 2020</div></body>") == whole
    assert words(f"<body><a href=1>a</a> | <a href=2>bb</a><div>{LONG * 3}</div></body>") == whole


@pytest.mark.parametrize("page", ["<div>" * 200_000 + "</section>" * 80_000, "<b>" * 300_000 + "<p>" * 300_000, "<p>" + "<b>" * 200_000 + "<p></p>" * 100_000, "<ul>" + "<li>" * 300_000, "<p><td>" + "<b>" * 200_000 + "<p></p>" * 100_000])
def test_unclosed_tags_take_linear_time(page):
    start = time.process_time()
    H.main_text(page)
    assert time.process_time() - start < 3e-5 * len(page)


TAGS = ["div", "p", "b", "a", "ul", "li", "table", "tr", "td", "section", "span", "h2", "dl", "dt", "dd"]


def random_page(rng):
    out = []
    for _ in range(rng.randint(1, 60)):
        tag = rng.choice(TAGS)
        out.append(rng.choice([f"<{tag}>", f"<{tag}>", f"</{tag}>", f"w{rng.randint(0, 99)} ", "text runs on and on "]))
    return "".join(out)


def plain_tree(page):
    """The same tree by walking up from the open element for every tag."""
    root = H.Node("html", None)
    node = root
    for m in H.re.finditer(r"<(/?)([a-z0-9]+)>|[^<]+", page):
        if m[2] is None:
            node.children.append(m[0])
            continue
        tag = m[2]
        if m[1]:
            up = node
            while up is not None and up.tag != tag and not (tag not in H._BLOCKS and up.tag in H._SCOPES):
                up = up.parent
            if up is not None and up.tag == tag and up.parent is not None:
                node = up.parent
            continue
        if tag in H._CLOSES_P or tag == "p":
            up = node
            while up is not None and up.tag != "p" and up.tag not in H._SCOPES:
                up = up.parent
            if up is not None and up.tag == "p":
                node = up.parent
        if tag in H._SIBLINGS:
            up = node
            while up is not None and up.tag not in H._SIBLINGS[tag] and up.tag not in ("ul", "ol", "dl", "table", "select", "html"):
                up = up.parent
            if up is not None and up.tag in H._SIBLINGS[tag]:
                node = up.parent
        node.children.append(H.Node(tag, node))
        node = node.children[-1]
    return root


def form(node):
    return node if isinstance(node, str) else (node.tag, [form(c) for c in node.children])


def test_tags_close_as_by_walking():
    rng = random.Random(1)
    for _ in range(3000):
        page = random_page(rng)
        assert form(H.parse(page)) == form(plain_tree(page)), page


def counts(node):
    """(characters, tags, link characters, link tags) below a node, by recursion."""
    c = t = lc = lt = 0
    for x in node.children:
        if isinstance(x, str):
            c += len(" ".join(x.split()))
        else:
            a, b, d, e = counts(x)
            c, t, lc, lt = c + a, t + b + 1, lc + d, lt + e + (x.tag == "a")
    return c, t, c if node.tag == "a" else lc, lt


def density(node, root):
    c, t, lc, lt = counts(node)
    if not c:
        return 0.0
    whole = counts(root)
    ratio = whole[2] / max(1, whole[0])
    t, l, lt = max(1, t), max(1, lc), max(1, lt)
    return c / t * math.log(max(1, c / l * t / lt) + 1) / math.log(math.log(c / max(1, c - lc) * lc + ratio * c + math.e) + 1)


def test_densities_by_recursion():
    rng = random.Random(2)
    for _ in range(200):
        root = H.parse(random_page(rng))
        H.score(root)
        nodes = H._order(root)
        for x in nodes:
            assert x.density == pytest.approx(density(x, root))
            below = [density(c, root) for c in x.children if not isinstance(c, str)]
            assert x.total == pytest.approx(sum(below) or density(x, root))
        chosen = H.content(root)
        best = max(nodes, key=lambda x: x.total)
        if best.total and not any(x.tag in ("article", "main") for x in nodes):
            kept = " ".join(t for t in map(H.text_of, chosen) if t)
            assert H.text_of(best) in kept
