"""Rows of an invoice's text: each part is read once."""

from decimal import Decimal as D

from provena.sources import texts as T


def test_parts_of_a_line_are_read_once(spark):
    rows = spark.createDataFrame([(1, "Item Qty Price Total\r\nBig box  2,5  1.000,00  2500.00 \nOff 2 3 7\nPart 7  3  2.50  7.50\nsum 3."), (2, None)], "id int, text string")
    out = T.text_lines(rows, ["id"], "text")
    assert sorted((r.id, r.line, r.description, r.quantity, r.unit_price, r.total) for r in out.collect()) == [(1, 1, "Big box", D("2.500"), D("1000.00"), D("2500.00")), (1, 3, "Part 7", D("3.000"), D("2.50"), D("7.50"))]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") <= 4
