"""Texts directly in ancestors of the core, and forms around the article."""

import pytest
from guardloom.llm import html_text

LONG = "long words of a paragraph that goes on and on until it is long enough " * 3


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<article>Lead <b>sentence</b>.<div><p>{LONG}</p><p>{LONG}</p></div>Closing text.</article>", ["Lead sentence.", LONG, LONG, "Closing text."]),
        (f"<body><main>{LONG}<div><p>{LONG}</p><p>{LONG}</p></div>ok</main></body>", [LONG, LONG, LONG]),
        (f"<body>{LONG}<div><p>{LONG}</p><p>{LONG}</p></div><a href=x>{LONG}</a></body>", [LONG, LONG, LONG]),
        (f"<body><form id='form1'><div><p>{LONG}</p><p>{LONG}</p></div></form></body>", [LONG, LONG]),
        (f"<form><article><p>{LONG}</p></article></form>", [LONG]),
        (f"<article><form><p>{LONG}</p><p>{LONG}</p></form></article>", [LONG, LONG]),
        (f"<article><p>{LONG}</p><form>send this</form></article>", [LONG]),
    ],
)
def test_whole_article(page, want):
    assert html_text.main_text(page) == "\n\n".join(" ".join(x.split()) for x in want)


def test_density_path_without_article_tags():
    links = "<ul>" + "<li><a href=x>see</a>" * 8 + "</ul>"
    page = f"<body><div>{links}<div><p>{LONG}</p><p>{LONG}</p></div></div></body>"
    assert html_text.main_text(page) == "\n\n".join([LONG.strip()] * 2)
    inside = html_text.main_text(page.replace("<body><div>", "<body><article>").replace("</div></body>", "</article></body>"))
    assert inside.startswith("see")


@pytest.mark.parametrize(
    "inside, kept",
    [
        ("<div class='related-work'><p>A section of it.</p></div>", True),
        ("<p class='notice'>Mind this.</p>", True),
        ("<div class='search-results'><p>What was found.</p></div>", True),
        ("<div class='comments'><p>Nice one!</p></div>", False),
        ("<section id='reader comments'><p>Nice one!</p></section>", False),
        ("<div class='ad'>Buy this.</div>", False),
        ("<ul class='social-share'><li>Send it on</li></ul>", False),
    ],
)
def test_names_inside_an_article(inside, kept):
    got = html_text.main_text(f"<article><h1>T</h1><p>{LONG}</p>{inside}<p>{LONG}</p></article>").split("\n\n")
    assert len(got) == (4 if kept else 3)


def by_hand(page):
    """Density of every node of a page of divs and paragraphs without links, by the definition."""
    import re

    found, open_nodes = [], []
    for end, tag, text in re.findall(r"<(/?)(\w+)[^>]*>([^<]*)", page):
        if end:
            open_nodes.pop()
        else:
            node = {"tag": tag, "chars": 0, "tags": 0, "children": []}
            for up in open_nodes:
                up["tags"] += 1
            if open_nodes:
                open_nodes[-1]["children"].append(node)
            open_nodes.append(node)
            found.append(node)
        for up in open_nodes:
            up["chars"] += len(text.strip())
    for node in found:
        node["density"] = node["chars"] / max(node["tags"], 1)
    for node in found:
        node["sum"] = sum(c["density"] for c in node["children"])
    return found


def test_densities_by_the_definition():
    page = f"<body><div><p>short one</p></div><div><div><p>{LONG}</p><p>{LONG}</p><div><p>inner</p></div></div><p>beside it</p></div><div>foot</div></body>"
    root = html_text._tree(page)
    nodes = html_text._nodes(root)
    html_text._measure(nodes, next(n for n in nodes if n.tag == "body"))
    want = by_hand(page)
    assert [(n.tag, n.chars, n.tags) for n in nodes[1:]] == [(w["tag"], w["chars"], w["tags"]) for w in want]
    assert [n.density for n in nodes[1:]] == pytest.approx([w["density"] for w in want])
    assert [n.sum for n in nodes[1:]] == pytest.approx([w["sum"] for w in want])
    core = max(want, key=lambda w: w["sum"])
    assert core["chars"] > 2 * len(LONG) - 4 and html_text.main_text(page).split("\n\n") == [LONG.strip(), LONG.strip(), "inner"]


def test_pages_without_tags_that_say_what_they_are():
    """Of the pages of sf0.01, with nav, footer, article and class names read as plain divs, most give the same text and none less."""
    import re

    import pyarrow.dataset as ds

    same = 0
    for page in ds.dataset("/root/testdata/sf0.01/pages.parquet").to_table(columns=["html"])["html"].to_pylist():
        plain = re.sub(r"<(/?)(?:nav|footer|aside|header|form|article|main)\b", r"<\1div", re.sub(r' class="?\w+"?', "", page))
        want, got = html_text.main_text(page), html_text.main_text(plain)
        assert set(want.split("\n\n")) <= set(got.split("\n\n"))
        same += want == got
    assert same >= 210


def test_time_grows_with_the_length():
    import time

    def seconds(n):
        began = time.process_time()
        html_text.main_text("<div><p>a</p>" * n + "<center>" * n + "<li>x" * n + "</b></zz>" * n)
        return time.process_time() - began

    seconds(1000)
    assert seconds(40_000) < 30 * max(seconds(4_000), 0.02)
