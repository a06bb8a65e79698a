import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from quern.functions import moving_days, spans
from quern.operators import grid

D = dt.date
CASES = [
    ("2026.3.4 ~ 2026.3.6 camp", [(0, 19, D(2026, 3, 4), D(2026, 3, 6))]),
    ("from 3/4 to x, 5-6", [(5, 3, D(2026, 3, 4), D(2026, 3, 4)), (15, 3, D(2026, 5, 6), D(2026, 5, 6))]),
    ("3월 4일부터 6일, 4월 1일", [(0, 10, D(2026, 3, 4), D(2026, 3, 6)), (12, 5, D(2026, 4, 1), D(2026, 4, 1))]),
    ("2025년 12월 30일 ~ 2026년 1월 2일", [(0, 27, D(2025, 12, 30), D(2026, 1, 2))]),
    ("12.30 - 1.2 and 13.40 and 2.30", [(0, 11, D(2026, 12, 30), D(2026, 1, 2))]),
    ("10:30 1.2 1:3.4", [(6, 3, D(2026, 1, 2), D(2026, 1, 2))]),
    ("none", []), ("", []), ("2024.2.29 2023.2.29", [(0, 9, D(2024, 2, 29), D(2024, 2, 29))]),
    ("1.2 3.4 5.6", [(0, 3, D(2026, 1, 2), D(2026, 1, 2)), (4, 3, D(2026, 3, 4), D(2026, 3, 4)), (8, 3, D(2026, 5, 6), D(2026, 5, 6))]),
]


def test_spans_of_lines(spark):
    from quern.queries.dates import spans_of_lines

    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, line string")
    got = sorted((r.i, r.start, r.length, r.first, r.last) for r in spans_of_lines(rows, "i").collect())
    assert got == [(i, *span) for i, (_, found) in enumerate(CASES) for span in found]
    assert spans.with_spans(spark.createDataFrame([(None,)], "line string"), "line").first().spans is None


def test_moments_of_lines(spark):
    at = lambda h, m=0, day=4: dt.datetime(2026, 3, day, h, m)
    cases = [
        ("10:00 ~ 12:30 talk", (at(10), at(12, 30, 6), False)), ("9~11", (at(9), at(11, 0, 6), False)), ("talk 14:05", (at(14, 5), at(15, 5), False)), ("hand in by 23:59, due", (at(23, 59), at(23, 59) + dt.timedelta(minutes=1), False)),
        ("18:00까지", (at(18), at(18, 1), False)), ("all of it", (at(0), at(0, 0, 7), True)), ("25:00", (at(0), at(0, 0, 7), True)), ("10:75 - 12:00", (at(0), at(0, 0, 7), True)),
    ]
    rows = spark.createDataFrame([(i, c[0], D(2026, 3, 4), D(2026, 3, 6)) for i, c in enumerate(cases)], "i int, line string, first date, last date")
    for r in spans.with_moments(rows, "line").collect():
        assert (r.start_at, r.end_at, r.all_day) == cases[r.i][1], cases[r.i][0]


def test_spans_of_whole_documents(spark, sf):
    from quern.queries.dates import spans_of_lines

    lines = spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    got = sorted((r.doc_id, r.line_no, r.start, r.length, r.first, r.last) for r in spans_of_lines(lines, "doc_id", "line_no").collect())
    want = []

    def day(y, m, d):
        try:
            return D(int(y), int(m), int(d))
        except ValueError:
            return None

    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        for n, line in enumerate((r.text or "").split("\n")):
            at = 0
            while at < len(line):
                m = next((m for p in (spans.RANGE, spans.SINGLE) if (m := re.compile(p, re.ASCII).match(line, at))), None)
                if m is None:
                    at += 1
                    continue
                g = m.groups()
                first = day(g[0] or 2026, g[1], g[2])
                last = day(g[3] or g[0] or 2026, g[4] or g[1], g[5]) if len(g) > 3 else first
                if first and last:
                    want.append((r.doc_id, n, at, m.end() - at, first, last))
                at = m.end()
    assert got == sorted(want)


NEW_YEAR = "2000-02-05 2001-01-24 2002-02-12 2003-02-01 2004-01-22 2005-02-09 2006-01-29 2007-02-18 2008-02-07 2009-01-26 2010-02-14 2011-02-03 2012-01-23 2013-02-10 2014-01-31 2015-02-19 2016-02-08 2017-01-28 2018-02-16 2019-02-05 2020-01-25 2021-02-12 2022-02-01 2023-01-22 2024-02-10 2025-01-29 2026-02-17 2027-02-07 2028-01-27 2029-02-13 2030-02-03"
HARVEST = "2000-09-12 2001-10-01 2002-09-21 2003-09-11 2004-09-28 2005-09-18 2006-10-06 2007-09-25 2008-09-14 2009-10-03 2010-09-22 2011-09-12 2012-09-30 2013-09-19 2014-09-08 2015-09-27 2016-09-15 2017-10-04 2018-09-24 2019-09-13 2020-10-01 2021-09-21 2022-09-10 2023-09-29 2024-09-17 2025-10-06 2026-09-25 2027-09-15 2028-10-03 2029-09-22 2030-09-12"


def test_moving_holidays_of_thirty_years():
    for year, (a, b) in enumerate(zip(NEW_YEAR.split(), HARVEST.split()), 2000):
        assert (str(moving_days.from_lunar(year, 1, 1)), str(moving_days.from_lunar(year, 8, 15))) == (a, b)
    assert [k[0] for y in (2020, 2023, 2025) for k in moving_days.months(y) if k[1]] == [4, 2, 6]
    assert moving_days.from_lunar(2026, 4, 8) == D(2026, 5, 24) and moving_days.from_lunar(2027, 4, 8) == D(2027, 5, 13)


@pytest.mark.parametrize(("year", "days"), [(2021, "8-16 10-4 10-11"), (2022, "9-12 10-10"), (2023, "1-24 5-29"), (2024, "2-12 5-6"), (2025, "3-3 5-6 10-8"), (2026, "3-2 5-25 8-17 10-5")])
def test_substitute_days(year, days):
    assert [f"{d.month}-{d.day}" for d, n in moving_days.holidays(year).items() if n.endswith("substitute")] == days.split()


def test_cells_above_are_those_of_comparing_all(spark):
    rng = random.Random(4)
    cells = [(p, i, c, 10.0 * c, 10.0 * c + 10, float(rng.randint(0, 20))) for p in range(3) for i, c in enumerate(rng.choices(range(4), k=15))]
    boxes = [(p, i, float(rng.choice([0, 5, 10, 15, 33, 40, 41])), float(rng.randint(-2, 25))) for p in range(4) for i in range(60)]
    got = grid.cell_above(spark.createDataFrame(boxes, "page int, box_no int, cx double, cy double"), spark.createDataFrame(cells, "page int, cell_no int, column_no int, x1 double, x2 double, y1 double"))
    want = []
    for p, b, cx, cy in boxes:
        near = [(cy - y, n) for q, n, _, x1, x2, y in cells if q == p and x1 <= cx <= x2 and y <= cy]
        want += [(p, b, min(near)[1])] if near else []
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_lines_of_one_text_are_scanned_once_and_all_have_their_spans(spark):
    from quern.queries import dates

    texts = ["due 2026-03-04 14:05", "2026/3/5 or 2026.4.6", "no digits", None, "7"]
    lines = spark.createDataFrame([(i, texts[i % 5]) for i in range(500)], "n int, line string")
    found = dates.spans_of_lines(lines, "n")
    got = sorted((r.n, r.start, str(r.first)) for r in found.collect())
    assert got == sorted((i, *s) for i in range(500) for s in ([[(4, "2026-03-04")], [(0, "2026-03-05"), (12, "2026-04-06")]] + [[]] * 3)[i % 5])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "regexp_extract_all" not in plan[plan.index("Aggregate [line") :]
