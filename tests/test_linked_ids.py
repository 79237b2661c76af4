"""Links of pages are looked for by the query and by its SQL; the given pages have none."""

import pytest
from duck import connect, same

from asofia.plans import extraction
from asofia.sources.folders import work_folder

LINK = '<a href="{}">x</a>'.format
PAGES = [
    (1, LINK("NotificationUser.aspx?Id=2&amp;Mode=0") + LINK("NOTIFICATIONUSER.ASPX?ID=1") + LINK("BS_ViewMasDirections.aspx?id=3")),
    (2, LINK("NotificationUser.aspx?Id=007") + LINK("/Scripts/NotificationUser.aspx?Id=7") + LINK("NotificationUser.aspx?Id=02") + LINK("NotificationUser.aspx?Id=000")),
    (None, LINK("NotificationUser.aspx?Id=5") + LINK("BS_ViewMasDirections.aspx?id=6") + LINK("NotificationUser.aspx?Id=5")),
    (4, LINK("NotificationPreVersion.aspx?id=9&Histid=1").replace("x</a>", "</a>") + LINK("/The") + LINK("NotificationUser.aspx?Id=")),
    (5, LINK("NotificationUser.aspx?Id=123456789012345678901234567890")),
]


def test_links_of_pages(spark):
    folder = work_folder(spark, "pages")
    rows = [(i, "u", f"<title>t</title>{links}<p>{'word ' * 50}</p>") for i, links in PAGES]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    same(spark, extraction.page_details, extraction.ORACLE["page_details"], folder)
    found = connect(folder).execute(f"select id, links from ({extraction.ORACLE['page_details']})").fetchall()
    assert sorted(found, key=str) == sorted([(1, 2), (2, 2), (None, 2), (4, 0), (5, 1)], key=str)


@pytest.mark.parametrize("html", [None, ""])
def test_a_page_without_text_links_to_nothing(spark, html):
    rows = extraction.extract.details(spark.createDataFrame([(1, html, "t")], "page_id long, html string, title string"))
    assert [r.linked_ids for r in rows.collect()] == [[]]
