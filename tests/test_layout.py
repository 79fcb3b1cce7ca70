import random

import pytest
from pyspark.sql import functions as F

from quire.operators import layout as L

BLOCK = "doc_id long, page_index long, block_no long, x0 double, y0 double, x1 double, y1 double, text string"


def clusters(points, eps, least):
    """Density clusters of points on a line, by spreading labels from cores."""
    near = [[j for j, q in enumerate(points) if abs(p - q) <= eps] for p in points]
    core = [len(n) >= least for n in near]
    label, k = [None] * len(points), 0
    for i in range(len(points)):
        if core[i] and label[i] is None:
            todo, k = [i], k + 1
            while todo:
                j = todo.pop()
                if label[j] is None:
                    label[j] = k
                    todo += [m for m in near[j] if core[j] and core[m] and label[m] is None]
    return k


def test_columns(spark):
    rng, rows, want = random.Random(2), [], {}
    for page in range(60):
        n = rng.randint(4, 20)
        centres = [rng.choice([100, 300, 500]) + rng.uniform(-60, 60) for _ in range(n)]
        for i, c in enumerate(centres):
            rows.append((1, page, i, c - 20.0, 0.0, c + 20.0, 10.0, "x" * 40))
        want[page] = 1 if n < 6 else max(1, clusters([c / 600 for c in centres], 0.15, 3))
    got = {r.page_index: r.n_columns for r in L.column_counts(spark.createDataFrame(rows, BLOCK)).collect()}
    assert got == want


def test_reading_order(spark):
    rows = [(1, 0, 0, 300.0, 100.0, 350.0, 110.0, "right"), (1, 0, 1, 10.0, 104.0, 60.0, 112.0, "left"), (1, 0, 2, 10.0, 400.0, 60.0, 410.0, "other")]
    got = {r.block_no: r.place for r in L.reading_order(spark.createDataFrame(rows, BLOCK)).collect()}
    assert got == {2: 1, 1: 2, 0: 3}


def test_tables():
    cells = [(10.0, 10.0, 50.0, 20.0, "a"), (100.0, 12.0, 140.0, 20.0, "b|c"), (10.0, 40.0, 50.0, 50.0, "1"), (104.0, 41.0, 140.0, 50.0, "2"), (10.0, 90.0, 500.0, 100.0, "text")]
    grid = L.table_grid(cells)
    assert grid == [["a", "b|c"], ["1", "2"]]
    assert L.grid_markdown(grid) == "| a | b\\|c |\n| --- | --- |\n| 1 | 2 |"
    assert L.table_grid(cells[:2]) is None and L.table_grid([]) is None


def test_cleanliness(spark):
    text = "The plain English words of a clean page go on and on without any marks. " * 12
    rows = [(1, p, 0, 50.0, 100.0, 500.0, 400.0, text) for p in range(3)] + [(2, 0, 0, 0.0, 0.0, 10.0, 10.0, "(cid:3) \ufffd\ufffd")]
    images = spark.createDataFrame([(2, 0, 0.0, 0.0, 600.0, 800.0)], "doc_id long, page_index long, x0 double, y0 double, x1 double, y1 double")
    got = {r.doc_id: r for r in L.cleanliness(L.document_metrics(spark.createDataFrame(rows, BLOCK), images)).collect()}
    assert (got[1].score, got[1].level, got[1].accepted, got[1].problems) == (100.0, "VERY_CLEAN", True, [])
    assert got[2].level == "NOT_RECOMMENDED" and not got[2].accepted and "LARGE_IMAGES" in got[2].problems and len(got[2].advice) >= 3


def test_encrypted_and_unlike_extractors(spark):
    from pyspark.sql import functions as F

    text = "The plain English words of a clean page go on and on without any marks. " * 12
    images = spark.createDataFrame([], "doc_id long, page_index long, x0 double, y0 double, x1 double, y1 double")
    metrics = L.document_metrics(spark.createDataFrame([(i, p, 0, 50.0, 100.0, 500.0, 400.0, text) for i in (1, 2, 3) for p in range(3)], BLOCK), images)
    got = {r.doc_id: r for r in L.cleanliness(metrics, F.col("doc_id") == 2, F.when(F.col("doc_id") == 3, 0.4)).collect()}
    assert (got[1].score, got[1].accepted) == (100.0, True)
    assert (got[2].score, got[2].problems, got[2].accepted) == (70.0, ["ENCRYPTED"], False)
    assert (got[3].score, got[3].problems, got[3].accepted) == (90.0, ["EXTRACTORS_DIFFER"], True)


def test_fitting_size(spark):
    def fits(text, width, height, size):
        per_line = max(1, int(width / max(1, size * 0.58)))
        n = sum(max(1, -(-len(x.strip()) // per_line)) for x in (text.splitlines() or [text]))
        return n * size * 1.2 <= height

    def best(source, target, width, height):
        base = max(5.0, min(12.0, height / max(1, len([x for x in source.splitlines() if x.strip()])) * 0.72))
        size = max(4.5, min(base, base * max(0.55, min(1.1, len(source) / max(1, len(target))))))
        while size >= 4.5:
            if fits(target, width, height, size):
                return size
            size -= 0.5
        return 4.5

    rng = random.Random(1)
    rows = [("s " * rng.randint(1, 60) + "\nx" * rng.randint(0, 3), "t" * rng.randint(0, 300) + "\n\nu" * rng.randint(0, 2), float(rng.randint(20, 400)), float(rng.randint(8, 120))) for _ in range(80)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, t string, w double, h double")
    got = [r[0] for r in df.orderBy("i").select(L.fitting_size(F.col("s"), F.col("t"), F.col("w"), F.col("h"))).collect()]
    assert got == pytest.approx([best(*r) for r in rows])


def test_joined_pages(spark):
    open_ = "This is a long page of text that does not come to an end but goes on with the"
    pages = spark.createDataFrame([(1, 0, open_), (1, 1, "rest of the sentence here. Done with it."), (1, 2, "A new page that begins afresh and ends."), (1, 3, " ")], "doc_id long, page_index long, text string")
    got = [(r.first_page, r.last_page) for r in L.joined_pages(pages).orderBy("first_page").collect()]
    assert got == [(0, 1), (2, 2)]
