import math
import random

from provena.operators import layout as L

BOX = "page int, box int, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double"


def grid(page, r, degrees, sizes, widths=(40, 90, 60, 120, 50), noise=1.5):
    """Boxes of blocks of rows x columns under each other, some spanning two columns, turned as a whole; and their places."""
    out, want, box, y, row = [], {}, 0, 50.0, 0
    for block, (rows, cols) in enumerate(sizes):
        lefts = [sum(w + 12 for w in widths[:k]) for k in range(cols)]
        for k in range(rows):
            c = 0
            while c < cols:
                span = 2 if cols > 2 and k and c + 1 < cols and r.random() < 0.2 else 1
                n = lambda: r.uniform(-noise, noise)
                left, right = lefts[c] + abs(n()), lefts[c + span - 1] + widths[c + span - 1] - abs(n())
                top = y + n()
                a = math.radians(degrees)
                turn = lambda x, y: (x * math.cos(a) - y * math.sin(a), x * math.sin(a) + y * math.cos(a))  # noqa: B023, E731
                out.append((page, box, *turn(left, top), *turn(right, top), *turn(left, top + 12)))
                want[box] = (row, block, c, span)
                box, c = box + 1, c + span
            y, row = y + 20, row + 1
        y += 40
    r.shuffle(out)
    return out, want


def test_grids_are_recovered(spark):
    r = random.Random(2)
    pages = {0: (0, [(4, 3)]), 1: (3.5, [(5, 4), (3, 2)]), 2: (-7, [(1, 1), (8, 5), (2, 3)]), 3: (0.4, [(30, 5)]), 4: (12, [(2, 2), (2, 2), (2, 2)])}
    rows, want = [], {}
    for page, (degrees, sizes) in pages.items():
        boxes, places = grid(page, r, degrees, sizes)
        rows += boxes
        want |= {(page, b): p for b, p in places.items()}
    df = spark.createDataFrame(rows, BOX).repartition(3)
    got = {(x.page, x.box): (x.row, x.block, x.column, x.span) for x in L.page_cells(df).collect()}
    assert got == want
    told = {x.page: x for x in L.page_layout(df).collect()}
    for page, (degrees, sizes) in pages.items():
        assert abs(told[page].skew - degrees) < 1e-6 and told[page].rows == sum(n for n, _ in sizes)
        assert told[page].blocks == len(sizes) and told[page].tables == sum(n >= 2 and c >= 2 for n, c in sizes)


def test_skew_is_the_median(spark):
    r = random.Random(1)
    boxes, _ = grid(0, r, 5, [(6, 3)])
    noisy = [(*b[:4], b[4], b[5] + (30 if k % 5 == 0 else 0), *b[6:]) for k, b in enumerate(boxes)]
    assert abs(L.page_skew(spark.createDataFrame(noisy, BOX)).first().skew - 5) < 1e-6
    assert L.page_layout(spark.createDataFrame([], BOX)).count() == 0


def test_boxes_dealt_by_page_are_not_moved_again(spark):
    names = [c.split()[0] for c in BOX.split(",")]
    df = spark.createDataFrame([(p, 10 * r + c, *map(float, (30 * c, 20 * r, 30 * c + 10, 20 * r, 30 * c, 20 * r + 12))) for p in range(5) for r in (0, 1, 5) for c in range(4)], BOX).repartition(6, names[0])
    rows = L.page_rows(df)
    assert sorted((x.row, x.block, x.nth) for x in rows.where("page = 3").collect()) == [(r, int(r == 2), c) for r in range(3) for c in range(4)]
    assert rows._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
    assert rows.groupBy("page", "row").count()._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
