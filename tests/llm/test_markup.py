import pytest

from textloom.llm import markup

PAGE = "<html><head><title>T</title></head><body><nav><a href='/'>Home</a></nav><h1>T</h1><p class='authors'>A, B</p><div class='abstract'>{}</div><footer>Printed page</footer></body></html>"
CASES = [
    ("<h2>One</h2><p>x <b>y</b></p><ul><li>a<li>b<ul><li>c</li></ul></ul>", (1, 3, 0, 0)),
    ("<div role='heading' aria-level='2'>H</div><PRE class=x># no\n- no</PRE><p>z <code>$x$</code></p>", (1, 0, 1, 0)),
    ("Text\n\n## Two\n\n* a\n  - b\n1. c\n2) d\n\n```r\n# code\n- no\n```\n\nHead\n----\n\nwith $a_1 = 2$ and $5 to $7", (2, 4, 1, 1)),
    ("== Head ==\n* a\n** b\n# c\n## d\n:<math>x</math>\n<syntaxhighlight lang=\"r\">* no</syntaxhighlight>", (1, 4, 1, 1)),
    ("\\section*{A}\\label{x}\n% \\section{Old}\n\\begin{itemize}\n\\item a\n\\item[--] b\n\\end{itemize}\n\\[ x \\]\nIt costs \\$5 \\(y\\)\n\\begin{equation*}z\\end{equation*}\n\\begin{verbatim}\n\\item no\n\\end{verbatim}", (1, 2, 1, 3)),
    ("&lt;h3&gt;A&lt;/h3&gt;&lt;ul&gt;&lt;li&gt;a&lt;/li&gt;&lt;/ul&gt;&lt;pre&gt;&amp;lt;li&amp;gt;&lt;/pre&gt;", (1, 1, 1, 0)),
    ("<!-- <h2>no</h2> --><script>var t = '<h3>no</h3>';</script><p>a < b and c > d<br/>* p&lt;0.05 # x</p>", (0, 0, 0, 0)),
    ("**Bold** start\n\n---\n\n> quote", (0, 0, 0, 0)),
    ("", (0, 0, 0, 0)),
]


@pytest.mark.parametrize("block, want", CASES)
def test_structure(block, want):
    got = markup.blocks(PAGE.format(block), markup.STUDY_TEXT)
    assert tuple(markup.structure(got[0]).values() if got else (0, 0, 0, 0)) == want


def test_content_is_found_by_density():
    page = PAGE.format("<p>" + "word " * 60 + "</p><p>" + "more " * 40 + "</p>").replace("class='abstract'", "")
    links = "<div>" + "<a href='x'>link text</a> " * 30 + "</div>"
    got = markup.blocks(page.replace("<nav>", links + "<nav>"))[0]
    assert got.startswith("<p>word") and "Printed" not in got and "link text" not in got


def test_render():
    text = markup.render("## A\n\n* b\n\n```r\nx <- 1\n```\n\nsee $y^2$ and **z** [n](u)")
    assert text == "# A\n- b\n\n```\nx <- 1\n```\n\nsee $y^2$ and z n"


def test_long_and_broken_pages():
    assert markup.blocks("") == [""]
    assert markup.blocks("<div class='abstract'>" + "<p>x" * 20000, markup.STUDY_TEXT)
    assert markup.structure("$" * 5000 + "`" * 5000 + "\\[" * 3000 + "<" * 5000)


def test_rows(spark):
    df = spark.createDataFrame([(1, PAGE.format("# A\n\n- x\n- y"), 9), (2, None, 9), (3, "", 9)], "raw_id long, page string, elem int")
    got = sorted(tuple(r) for r in markup.elements(df, "raw_id", "page", markup.STUDY_TEXT).collect())
    assert got == [(1, "heading", 1), (1, "list_item", 1), (1, "list_item", 2)] or got == [(1, "list_item", 1), (1, "list_item", 2), (1, "list_item", 3)]
    texts = {r[0]: r[1] for r in df.select("raw_id", markup.clean_text(df.page)).collect()}
    assert texts[2] is None and texts[3] == ""


TEXT = "<p>" + "The trial measured how long patients lived after the treatment. " * 6 + "</p><ul><li>first arm</li><li>second arm</li></ul>"
BOX = "<div class='related'><div class='abstract'><ul>" + "<li><a href='/a'>Another article</a></li>" * 9 + "</ul></div></div>"


def test_density_decides_between_blocks_of_a_class(monkeypatch):
    page = PAGE.format(TEXT).replace("<footer>", BOX + "<footer>")

    def items():
        return sum(markup.structure(b)["list_item"] for b in markup.blocks(page, markup.STUDY_TEXT))

    assert items() == 2
    monkeypatch.setattr(markup, "_content", lambda nodes, frames=True: (0, list(range(len(nodes))), 0.0))
    assert items() == 11


def test_density_finds_content_without_the_class():
    page = PAGE.format(TEXT).replace("class='abstract'", "class='text'").replace("<footer>", BOX.replace("class='abstract'", "class='box'") + "<footer>")
    assert [markup.structure(b)["list_item"] for b in markup.blocks(page, markup.STUDY_TEXT)] == [2]


def test_long_formulas_count():
    for n in (10, 280, 301, 5000):
        assert markup.structure(f"where $x{'+ y' * n}$ holds")["formula"] == 1
