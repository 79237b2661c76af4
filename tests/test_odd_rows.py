"""Queries and their SQL on rows that the given tables seldom have."""

from duck import connect, same

from asofia.plans import extraction, service
from asofia.sources.folders import work_folder


def stored(spark, table, schema, *found):
    folder = work_folder(spark, "odd")
    spark.createDataFrame(list(found), schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    return folder


def test_references_cut_before_their_semicolon(spark):
    pages = ["<title>a &amp&amp</title><p>a &amp&amp</p><p>b&copy c&ampd &am &amp;lt</p>", "<td>x&amp</td><p>y&lt<b>;</b>z &quot</p>", "<p>&amp;amp; &nbsp;&middot;</p>"]
    folder = stored(spark, "pages", "page_id long, url string, html string", *((i, "u", h) for i, h in enumerate(pages)))
    for name in ("page_blocks", "page_details"):
        same(spark, extraction.QUERIES[name], extraction.ORACLE[name], folder)


def test_quotes_full_of_line_ends(spark):
    lines = "Les Rech.\n" * 30
    texts = [lines, "Rech.\n" * 40, " " * 200, "a\n" * 60, "plain words " * 12, "\u00a0" * 15 + "une ligne\r\n\r\n" * 12, "x" * 120, "cafe\u0301 cre\u0300me\n" * 12, "short", None, "Les Rech.\n" * 3 + "Les Rech. " * 9]
    folder = stored(spark, "documents", "doc_id long, text string", *enumerate(texts))
    same(spark, service.QUERIES["quote_fuzzy_found"], service.ORACLE["quote_fuzzy_found"], folder)
    found = connect(folder).execute(service.ORACLE["quote_fuzzy_found"]).df()
    assert set(found["found"].dropna()) == {True, False}
