import itertools
import random

import numpy as np
import pytest

from stewardry.llm import markup

MODEL = markup.train()


def found(text):
    return markup.elements(markup.decide(MODEL, markup.parse(text)))


@pytest.mark.parametrize(
    "text,want",
    [
        ("# Setup notes\n\nSame here.", {"heading"}), ("Part 3\n------\n\nSame.", {"heading"}), ("===About it===\n\n[[link]]", {"heading", "other"}), ("<h5 id=x5>\n  Errata\n</h5>", {"heading"}), ("\\subsection*{About}", {"heading"}),
        ("- [ ] one\n- two", {"list"}), ("*one\n*two\n\n[[x]]", {"list", "other"}), ("[[x]]\n\n# one\n# two\n# three", {"list", "other"}), ("<ol type=\"a\">\n<li>one\n<li>two\n</ol>", {"list"}), ("\\begin{itemize}\n\\item one\n\\end{itemize}", {"list"}),
        ("```py\nif (a < 2) {\n# no\n}\n```", {"code"}), ("<pre><code>def f(x):\n  return *x*</code></pre>", {"code"}), ("So.\n\n    import x\n    x.run()", {"code"}), ("\\begin{verbatim}\n$x$\n\\end{verbatim}", {"code"}), ("<syntaxhighlight lang=\"c\">\nint a;\n</syntaxhighlight>\n''x''", {"code", "other"}),
        ("so $x_i^2$ holds", {"formula"}), ("$$\n\\frac{a}{b} < c_1\n$$", {"formula"}), ("<span class=\"math\">\\(x\\)</span>", {"formula"}), ("<math><mi>x</mi></math>", {"formula"}), ("\\begin{align*}\na &= b \\\\\n\\end{align*}", {"formula"}),
        ("use `x` here", {"other"}), ("it&#39;s", {"other"}), ("was ~~not~~ it", {"other"}), ("> quoted", {"other"}), ("It is new <p class=\"foot", {"other"}), ("| a | b |\n|---|---|\n| c | d |", {"other"}), ("late.~\\cite{k30}", {"other"}),
        ("It costs $5 now, not $9.", set()), ("That is 2 * 3 * 7 cases.", set()), ("x == y fails while a < b holds.", set()), ("Look for max_open_rows in it.", set()), ("It came in at #3.", set()), ("Mine lives under C:\\temp\\new.", set()), ("R&D wrote [sic] ~5 times.", set()), ("", set()),
    ],
)
def test_kinds_of_elements(text, want):
    assert found(text) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("- so $x_i^2$ holds\n- two", {"list", "formula"}), ("<ul><li><pre>a\nb</pre></li><li>two</li></ul>", {"list", "code"}), ("\\begin{itemize}\n\\item $x^2$\n\\end{itemize}", {"list", "formula"}),
        ("\\section{The $x^2$ case}", {"heading", "formula"}), ("\\begin{document}\n\\section{One}\n\\begin{verbatim}\na\n\\end{verbatim}\n\\end{document}", {"heading", "code", "other"}),
    ],
)
def test_blocks_in_blocks(text, want):
    assert found(text) == want


def test_indented_dashes_reach_the_parser(spark):
    df = spark.createDataFrame([(1, "Title\n ---"), (2, "a\n\n   ---\n\nb")], "id bigint, body string")
    assert {r.id: tuple(r.elements) for r in markup.find_elements(df, ["id"], "body").collect()} == {1: ("heading",), 2: ("other",)}


def test_held_out_pages():
    r = random.Random(4711)
    pages = [markup._labelled_page(r) for _ in range(600)]
    right = sum(found(text) == {e for *_, e in spans if e != "text"} for text, _, spans in pages)
    assert right / len(pages) > 0.98


def test_messages_equal_enumeration():
    """Marginals by message passing against summing over all assignments of small trees."""
    small = markup.Model(MODEL.root, MODEL.top[:, :4], MODEL.below[:4, :4], {k: v[:4] for k, v in MODEL.emit.items()}, MODEL.unseen[:4])
    states, markup_states = range(4), markup.STATES
    leaf, parent = ("m_code", ()), ("m_quote", (("m_code", ()), ("m_strong", ())))
    markup.STATES = markup_states[:4]
    try:
        got = markup.marginals(small, (leaf, parent))
    finally:
        markup.STATES = markup_states
    want = {"leaf": np.zeros(4), "parent": np.zeros(4), "child": np.zeros(4)}
    for root, a, b, c, d in itertools.product(range(len(markup.ROOTS)), states, states, states, states):
        p = small.root[root] + small.top[root, a] + small.emission("m_code")[a] + small.top[root, b] + small.emission("m_quote")[b]
        p += small.below[b, c] + small.emission("m_code")[c] + small.below[b, d] + small.emission("m_strong")[d]
        for name, s in (("leaf", a), ("parent", b), ("child", c)):
            want[name][s] += np.exp(p)
    assert np.allclose(got[leaf][0], want["leaf"] / want["leaf"].sum())
    assert np.allclose(got[parent][0], want["parent"] / want["parent"].sum())
    assert np.allclose(got[parent][1]["m_code", ()][0], want["child"] / want["child"].sum())


def test_clean_text_keeps_structure():
    text = "<h2>About <b>it</b></h2>\n\nIt&#39;s <em>so</em>.\n\n<ul><li>one</li><li>two</li></ul>\n\n<pre>a &lt; b\nc</pre>\n\n$$x^2$$"
    assert markup.clean(MODEL, text) == "# About it\n\nIt's so.\n\n- one\n- two\n\n```\na < b\nc\n```\n\n$x^2$"
    assert markup.clean(MODEL, "## Notes ##\n\nA `b` [c](d).\n\n1. x\n2. *y*") == "# Notes\n\nA b c.\n\n- x\n- y"
    assert markup.clean(MODEL, "Plain, 2 * 3 * 7.") == "Plain, 2 * 3 * 7."


def test_tables_nulls_repeats_and_clashing_names(spark):
    rows = [(1, "# a", "x"), (1, "# a", "x"), (2, None, "x"), (3, "", None), (None, "use `x`", "x"), (2**60 + 1, "plain", "x"), (4, "so `x` " * 20000, "x")]
    df = spark.createDataFrame(rows, "id bigint, body string, elements string")
    got = sorted((r.id or 0, tuple(r.elements)) for r in markup.find_elements(df, ["id"], "body").collect())
    assert got == [(0, ("other",)), (1, ("heading",)), (1, ("heading",)), (4, ("other",))]
    clean = {r.id: r.clean for r in markup.clean_texts(df, ["id"], "body").collect()}
    assert clean[2] is None and clean[3] == "" and clean[2**60 + 1] == "plain" and clean[None] == "use x" and clean[4] == "so x " * 20000
    assert markup.find_elements(df.limit(0), ["id"], "body").count() == 0


@pytest.mark.parametrize(
    "text,want,cleaned",
    [
        ("<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>", {"list"}, "- a\n- b\n- c"),
        ("<ul><li>first <pre>x = 1</pre></li><li>two</li></ul>", {"list", "code"}, "- first \n```\nx = 1\n```\n- two"),
        ("> # Title\n> - one\n> - two", {"heading", "list", "other"}, "# Title\n- one\n- two"),
        ("<h1>Open heading\n\nbody one.\n\nbody two.", {"heading"}, "# Open heading\n\nbody one.\n\nbody two."),
        ("<div><h2>T</h2><p>so</p></div>", {"heading", "other"}, "# T\n\nso"),
    ],
)
def test_blocks_within_blocks(text, want, cleaned):
    model = markup.train()
    assert markup.elements(markup.decide(model, markup.parse(text))) == want
    assert markup.clean(model, text) == cleaned


def test_tags_hold_what_stands_between_them():
    div, after = markup.parse("<div>one <b>two <i>three</i></b> four</div> <br>")
    (bold,) = div.children
    assert [c.seen for c in bold.children] == ["h_tag"] and after.children == [] and (div.start, div.end) == (0, 43)
    deep = markup.parse("<div>" * 3000 + "x" + "</div>" * 3000 + "<ul>\n\n" * 3000)
    markup.elements(markup.decide(markup.train(), deep))


def test_lists_close_where_their_own_tag_is():
    (outer,) = markup.parse("<ol><li>a<ul><li>b</li></ul></li></ol>")
    assert outer.seen == "h_list" and outer.end == 38
