"""Pages from the sorted layout equal pages from the whole table, and read few files however large it is."""

import datetime as dt

import pytest

from offerlens.operators import explorer as X
from offerlens.operators import layout as L
from offerlens.sources.tables import scratch_path


def _rows(spark, n):
    days = f"case when id % 7 <> 0 then timestamp '2024-01-01 00:00:00' + cast(id % {max(n // 3, 1)} as int) * interval '1' minute end"
    return spark.range(n).selectExpr("lpad(cast((id * 7919) % 100003 as string), 8, '0') as offer_id", f"{days} as source_published_at", "cast(if(id % 5 = 0, null, id % 40) as int) as minimum_experience_months", "id % 50 = 3 as rare")


@pytest.mark.parametrize("sort", ["published_desc", "published_asc", "experience_desc"])
def test_walk_over_all_pages(spark, sort):
    rows, path, column = _rows(spark, 230), scratch_path(spark, "layout"), X.SORTS[sort][0]
    L.write_layout(rows, path, column, 9)
    want = [tuple(r) for r in rows.orderBy(*X.sort_order(sort)).select("offer_id", column).collect()]
    got, after = [], None
    while True:
        page, _ = L.layout_page(spark, path, sort, 50, after)
        own = [tuple(r) for r in page.orderBy(*X.sort_order(sort)).select("offer_id", column).collect()]
        got += own[:50]
        if len(own) <= 50:
            break
        after = (own[49][1], own[49][0])
    assert got == want


def test_files_of_a_page_do_not_grow_with_the_table(spark):
    read, rare = [], []
    for n in (3000, 30_000):
        path = scratch_path(spark, "layout")
        L.write_layout(_rows(spark, n), path, "source_published_at", n // 300)
        after = (dt.datetime(2024, 1, 1, 5), "00000000")
        page, files = L.layout_page(spark, path, "published_asc", 25, after)
        assert page.count() == 26
        read.append(len(files))
        page, files = L.layout_page(spark, path, "published_asc", 25, after, lambda rows: rows.filter("rare"))
        assert page.count() == 26
        rare.append(len(files))
    assert read == [2, 2] and max(rare) <= 9
    page, files = L.layout_page(spark, path, "published_desc", 5, (None, "00000000"))  # after the very last row
    assert (page.count(), files) == (0, [])
