from __future__ import annotations

from tests.compare import difference
from tests.llm.conftest import odd_rows

from skyfold.llm import templates
from skyfold.llm.common import documents


def test_templates_generalise_variable_fields(spark, duck_docs):
    names = "anna bert cleo dora emil fritz gerd hugo".split()
    rows = [(i, f"unique {n} line {n}\nPosted on 2024 by {n} in the forum\nmore {n} text") for i, n in enumerate(names)]
    rows += [(20, "Posted on 2024 by nobody at the harbour"), (21, "a line of its own\nPosted on 2024 by anna in the forum"), (22, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in templates.line_report(df).collect()}
    assert got[3].text == "unique dora line dora\nmore dora text" and got[3].n_dropped == 1
    assert got[20].n_dropped == 0 and got[21].text == "a line of its own" and got[22].text == got[0].text
    con, sql = duck_docs(df, templates.LINES_SQL)
    assert difference(templates.line_report(df), con, sql) is None


def test_long_passages_and_digits(spark, duck_docs):
    passage = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    short = " ".join(passage.split()[:50])
    rows = [(1, f"first\n{passage}\nof one"), (2, f"second\n{passage}"), (3, f"third\n{short}"), (4, f"fourth\n{short}")]
    rows += [(10 + i, f"text {c}\nPage 1 of 10\nTel. {i}{i}{i} 0{i}00") for i, c in enumerate("abcdef")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in templates.line_report(df).collect()}
    assert got[1] == "first\nof one" and got[2] == "second" and got[3] == f"third\n{short}"
    assert got[12] == "text c\nTel. 222 0200"
    con, sql = duck_docs(df, templates.LINES_SQL)
    assert difference(templates.line_report(df), con, sql) is None


def test_against_sql(spark, odd, none, duck_docs):
    for df in (odd, documents(spark, "/root/testdata/sf0.001")):
        con, sql = duck_docs(df, templates.LINES_SQL)
        assert difference(templates.line_report(df), con, sql) is None
    assert templates.line_report(odd).count() == len(odd_rows()) and templates.line_report(none).count() == 0
