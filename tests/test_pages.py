import html
import random
import re

import pytest

from matchflow.sources import pages as p

WORDS = ["senior", "go", "x", "team é", "&amp;", "a&lt;b", "  ", "\n", "pay", "🙂 one"]
TAGS = ["div", "div", "section", "main", "article", "span", "nav", "aside", "ul"]
MARKS = ["", "", ' class="jobs wide"', " class='job-description'", ' class="my-job-description-x"', ' role="main"', ' id="job-description-1"', ' class="jd-content2"']


class Node:
    def __init__(self, tag, attributes, children):
        self.tag, self.attributes, self.children = tag, attributes, children

    def markup(self):
        return f"<{self.tag}{self.attributes}>" + "".join(c if isinstance(c, str) else c.markup() for c in self.children) + f"</{self.tag}>"

    def without(self, tags):
        return Node(self.tag, self.attributes, [c if isinstance(c, str) else c.without(tags) for c in self.children if isinstance(c, str) or c.tag not in tags])

    def text(self):
        return "".join(html.unescape(c) if isinstance(c, str) else c.text() for c in self.children)

    def all(self):
        yield self
        for c in self.children:
            if not isinstance(c, str):
                yield from c.all()

    def has(self, selector):
        of = {k: v for k, _, v in re.findall(r"(\w+)=([\"'])(.*?)\2", self.attributes)}
        if selector[0] == ".":
            return selector[1:] in of.get("class", "").split()
        if selector[0] == "[":
            name, value = re.match(r"\[(\w+)\*?=\"(.*)\"", selector).groups()
            return value in of.get(name, "") if "*=" in selector else of.get(name) == value
        return self.tag == selector


def tree(rng, depth):
    kids = []
    for _ in range(rng.randint(1, 5)):
        if depth and rng.random() < 0.6:
            kids.append(tree(rng, depth - 1))
        else:
            kids.append("".join(rng.choice(WORDS) + rng.choice(["", " ", "\n "]) for _ in range(rng.randint(1, 40))))
    return Node(rng.choice(TAGS), rng.choice(MARKS), kids)


def units(text):
    return len(text.encode("utf-16-le")) // 2


def densest(root, length):
    best, score = None, 0
    for e in root.all():
        n = length(e)
        if e.tag == "div" and n >= 200:
            d = n / (sum(not isinstance(c, str) for c in e.children) or 1)
            if d > score:
                best, score = e, d
    return best


def by_document(root, selectors):
    return [next((e for e in root.all() if e.has(s)), None) for s in selectors]


def main_of(root):
    root = root.without(p.C.BOILERPLATE_TAGS)
    for e in by_document(root, p.C.MAIN_CONTAINERS):
        if e and units(e.text()) > 200:
            return p.squeezed(e.text())
    e = densest(root, lambda e: units(e.text()))
    return p.squeezed((e if e and units(e.text()) > 200 else root).text())


def probe_of(root):
    root = root.without(p.C.PROBE_BOILERPLATE_TAGS)
    size = lambda e: units(p.squeezed(e.text()))
    best = None
    for e in by_document(root, p.C.PROBE_CONTAINERS):
        if e and size(e) > (size(best) if best else 0):
            best = e
    if best is None or size(best) < 200:
        best = densest(root, size) or best
    return p.squeezed((best if best and size(best) >= 200 else root).text())


@pytest.mark.parametrize("seed", range(300))
def test_one_pass_is_a_document_tree(seed):
    rng = random.Random(seed)
    root = Node("section", "", [tree(rng, rng.randint(0, 5)) for _ in range(rng.randint(1, 3))])
    page = "<!-- <main> --><!DOCTYPE html>" + root.markup()
    assert p.main_content(page) == main_of(root)
    assert p.probe_content("<html><head><title>T</title></head><body>" + page + "</body></html>") == probe_of(root)


LONG = "word " * 60


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("  plain \n text ", "plain text"),
        ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        (f"<nav>no</nav><main>short</main><article>{LONG}</article><aside>no</aside>", LONG.strip()),
        (f"<main>{LONG}<button>Apply</button></main>", LONG.strip()),
        (f'<div><p>x</p><p>y</p><div id="b">{LONG}</div></div>', LONG.strip()),
        ("<p>a</p><p>b</p>", "ab"),
        ("<title>T</title><body><p>x<p>y", "Txy"),
        (f"<div><script>var a = '<div>{LONG}</div>'</script>ok</div>", "ok"),
        (f"<div>{LONG}<a href='x>y'>z</a></div>", LONG + "z"),
        ("<div>cut <a href='", "cut"),
        ("<div>cut <!-- never ends", "cut"),
        ("a < b <i>c</i>", "a < b c"),
        (f"<ul><li>a<li>b</ul><div>{LONG}<li>x<li>y</div>", LONG + "xy"),
    ],
)
def test_main_text_by_hand(page, want):
    assert p.main_content(page) == want


def test_children_are_counted_after_implied_ends():
    b = p.Blocks(frozenset(), []).read("<div><p>a<p>b<p>c<br></div><div><ul><li>x<li>y</ul></div><div><b>1<i>2</b>3</i></div>")
    assert [e.children for e in b.divs] == [3, 1, 1]


def test_time_is_linear_in_odd_markup():
    for page in ("<a b='" * 200_000, "<div>" * 100_000 + "x" * 300, "<" * 500_000, "<!--" * 200_000, "<p>" * 200_000, "</div>" * 200_000):
        p.main_content(page)
        p.probe_content(page)


def test_pages_as_a_table(spark):
    rows = [
        (1, f'<main>{LONG}Senior  Product Manager</main><a href="mailto:a@x.org?s">'),
        (2, f"<main>{LONG}engineering</main><a href='MAILTO:me@example.com'><a href='mailto:b@x.org'>"),
        (3, "<main>short</main>"),
        (4, None),
    ]
    got = {r["page_id"]: r for r in p.extract_page_text(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert set(got) == {1, 2}
    assert (got[1]["mail"], got[1]["has_job_title"], got[1]["n_words"]) == ("a@x.org?s", True, 63)
    assert (got[2]["mail"], got[2]["has_job_title"]) == (None, False)
    assert {r["page_id"]: r["text"] for r in p.extract_main_content(spark.createDataFrame(rows, "page_id long, html string")).collect()}[4] == ""
