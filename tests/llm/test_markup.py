import pytest
from pyspark.sql import functions as F

from strataform.llm import markup

FOUND = [
    ("It is R&amp;D work.", {"html"}), ("H<sub>2</sub>O is there.", {"html"}), ("It&#x2019;s final.", {"html"}), ("<!-- draft -->Text.", {"html"}), ("Text<o:p></o:p>", {"html"}), ("<h2>Cut off", {"html"}),
    ("**Bold** word", {"markdown"}), ("Say *so* now", {"markdown"}), ("a `code` word", {"markdown"}), ("[t](http://u.test/x)", {"markdown"}), ("Title\n=====\n\ntext", {"markdown"}), ("see it.[^1]", {"markdown"}),
    ("- [ ] task", {"markdown"}), ("| a | b |\n|---|---|\n| 1 | 2 |", {"markdown"}), ("> quoted", {"markdown"}), ("See [the plan][p1].\n\n[p1]: https://u.test/4", {"markdown"}), ("* * *", {"markdown"}), ("~~gone~~", {"markdown"}),
    ("== Head ==", {"wiki"}), ("[[Page|shown]] text", {"wiki"}), ("{{stub}}", {"wiki"}), ("'''bold'''", {"wiki"}), ("{|\n| a || b\n|}", {"wiki"}), ("== H ==\n* one\n* two", {"wiki"}), ("#REDIRECT [[Other]]", {"wiki"}), ("[https://u.test/4 label]", {"wiki"}),
    ("With $a^2 + b^2$ it holds.", {"latex"}), ("\\section{Head}", {"latex"}), ("See Fig.~\\ref{fig:a}.", {"latex"}), ("up 9 \\% now", {"latex"}), ("r\\'esum\\'e", {"latex"}), ("\\(k \\geq 2\\) is enough.", {"latex"}), ("\\[ a = b \\]", {"latex"}), ("a\\\\[2mm]b", {"latex"}),
    ("```\n\\section{x} <b>y</b> [[z]]\n```", {"markdown"}), ("<pre>== x ==\n\\emph{y}</pre>", {"html"}), ("\\begin{verbatim}\n**x** <b>\n\\end{verbatim}", {"latex"}),
]
PLAIN = [
    "", " \n ", "Multiply 5 * 5 * 9 before rounding.", "The budget moved from $122 to $462 within a week.", "Items #2 to #5 cost 50$ per seat, later 60$.", "We <3 short meetings, and x < y holds.", "The R&D; then the Q&A session.",
    "The key lives in C:\\temp\\new_plan or ~/plans/v4.", "Drop it under \\\\vault\\plans\\draft11.", "Rename user_id_map to file_id_map.", "*Prices exclude tax, and the option (a) [b] {c} is open.", "Fill in {name} and {date}.", "See <- and ->, then =>.",
    "• one\n• two", "Team C# and F#", "With |x| < 4 and 2^10 samples the n_max stays.", "The pair [5, 6] is a sample [sic].", "Use f(x) = x^2, not a == b.", "Start it with --verbose, 'yes' or \"no\".", "load < 50 and errors > 9", "About 100 % and ~ 59 people. ~~~~",
]


@pytest.mark.parametrize("text,languages", FOUND)
def test_found(text, languages):
    assert markup.convert(text).languages == languages


@pytest.mark.parametrize("text", PLAIN)
def test_plain(text):
    assert markup.convert(text).languages == set()


def test_structure_is_kept():
    md = "# Title\n\nSome **bold** text with a [link](http://x.test).\n\n- one\n- two\n\n```py\nfor x in y:\n    z(x)\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n$$\na^2\n$$\n"
    assert markup.convert(md).text() == "# Title\n\nSome bold text with a link.\n\n• one\n• two\n\nfor x in y:\n    z(x)\n\na | b\n1 | 2\n\na^2"


def test_the_four_languages_agree():
    html = "<html><head><title>t</title><style>p{x:y}</style></head><body><h1>Title</h1><p>It is <b>so</b> &amp; ends.</p><ul><li>one</li><li>two</li></ul><table><tr><td>a</td><td>b</td></tr></table></body></html>"
    wiki = "= x =\n== Title ==\n\nIt is '''so''' & ends.\n\n* one\n* two\n\n{| class=t\n| a || b\n|}"
    tex = "\\documentclass{article}\n\\begin{document}\n\\section{Title}\nIt is \\textbf{so} \\& ends.\n\\begin{itemize}\n  \\item one\n  \\item two\n\\end{itemize}\n\\begin{tabular}{ll}\na & b\n\\end{tabular}\n\\end{document}"
    for text in (html, wiki, tex):
        out = markup.convert(text).text()
        for part in ("# Title", "It is so & ends.", "• one\n• two", "a | b"):
            assert part in out
        assert not any(x in out for x in ("<", "'''", "\\", "{"))


def test_trees_learn_their_tables():
    for kind, *row in markup.LABELLED:
        assert markup.KINDS[markup.decide(markup.TREES.role, row)] == kind
    for languages, text in markup.WRITTEN:
        assert markup.convert(text).languages == set(languages.split())


def test_the_trees_decide():
    """With a tree of one leaf no language is found, or every one that has a sign; no menu is dropped."""
    text = "== Head ==\n\n* one\n\nText."
    none, every = (markup.Trees(markup.TREES.role, markup.Node(k)) for k in (0, 1))
    assert markup.convert(text).languages == {"wiki"}
    assert markup.convert(text, none).languages == set()
    assert markup.convert(text, every).languages == {"markdown", "wiki"}
    page = "<a href=a>Home</a><br><br><a href=b>Next page</a><br><br><p><a href=c>Imprint</a></p><p>The plan was read in the meeting, and nobody had any question about it.</p>"
    assert markup.convert(page).text() == "The plan was read in the meeting, and nobody had any question about it."
    kept = markup.convert(page, markup.Trees(markup.Node(0), markup.TREES.language)).text()
    assert "Home" in kept and "Next page" in kept


def test_neighbours_and_words_tell_menus_from_links_in_text():
    prose = "The plan was read in the meeting, and nobody had any question about the costs of it."
    assert markup.convert(f"{prose}\n\n[The plan](http://a.test)\n\n{prose}").text() == f"{prose}\n\nThe plan\n\n{prose}"
    assert markup.convert(f"[Home](http://a.test)\n\n[The plan](http://a.test)\n\n[Next](http://a.test)\n\n{prose}").text() == prose
    linked = "[" + " ".join(["The report of the audit office on the retention of old files"] * 3) + "](http://a.test)."
    assert "audit office" in markup.convert(f"[Home](http://a.test)\n\n{linked}\n\n[Next](http://a.test)").text()


@pytest.mark.parametrize("end", [".", "!", "?", ":", ";", ",", "。", "…"])
def test_final_punctuation_changes_no_role(end):
    text = f"## What changed{end}\n\n- one{end}\n- two{end}\n\n```\nint x = 1{end}\n```\n\n| a | b{end} |\n|---|---|\n| 1 | 2{end} |\n\n$$a = b{end}$$\n\nThe end{end}"
    assert markup.convert(text).text() == f"## What changed{end}\n\n• one{end}\n• two{end}\n\nint x = 1{end}\n\na | b{end}\n1 | 2{end}\n\na = b{end}\n\nThe end{end}"
    assert [b.kind for b in markup.convert(text).blocks if b.kind != "residue"] == ["heading", "list", "list", "code", "table", "table", "formula", "text"]


def test_rows(spark):
    docs = spark.createDataFrame([("a", "<b>x</b>", 1), ("a", "<b>x</b>", 1), ("a", "$x^2$", 1), ("b", None, 1), (None, "`x`", 1), ("c", "", 1), ("d", "# " + "y" * 100_000, 1)], "id string, text string, markup int")
    got = {tuple(r) for r in markup.markup_found(markup.clean_documents(docs, F.col("id"), F.col("text"))).collect()}
    assert got == {("doc", "a", "html"), ("doc", "a", "latex"), ("doc", None, "markdown"), ("doc", "d", "markdown")}
    chunks = spark.createDataFrame([("a:0", ["A", None, "**B**", ""]), ("a:1", None), ("a:2", [])], "id string, breadcrumbs array<string>")
    rows = {r.record_id: (list(r.markup), r.clean_text) for r in markup.clean_breadcrumbs(chunks, F.col("id"), F.col("breadcrumbs")).collect()}
    assert rows == {"a:0": (["markdown"], "A › B"), "a:2": ([], "")}
    assert markup.clean_documents(docs.limit(0), F.col("id"), F.col("text")).count() == 0


@pytest.mark.parametrize("opening, closing", [("$$", "$$"), (r"\[", r"\]"), (r"\begin{align}", r"\end{align}"), (r"\(", r"\)")])
def test_long_formulas_are_kept(opening, closing):
    body = r"\frac{a_1}{b} + \\[2pt] " * 300 + "c"
    text = f"Before the *first* one.\n\n{opening}{body}{closing}\n\nBetween the *two* of them.\n\n{opening}x^2{closing}\n\nAfter."
    got = markup.convert(text).text()
    assert body in got and "x^2" in got and "Between the two of them." in got and "Before the first one." in got
