"""Layout analytics over text blocks of pages: (doc_id, page_index, block_no, x0, y0, x1, y1, text)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import CID_LOOSE, academic_marks, count, english_word_ratio, garbled_ratio, lines, normal_line, normal_pattern, strip

PAGE = ("doc_id", "page_index")
#: fixed values: limits of the cleanliness check
MIN_CHARS, MAX_GARBLED, MIN_ENGLISH, MAX_IMAGES, MAX_COLUMNS, MAX_FRAGMENTS = 500.0, 0.01, 0.45, 0.35, 0.30, 0.55


def _bare(x: str = "text") -> Column:
    return strip(F.col(x))


def column_counts(blocks: DataFrame, width: Column | None = None) -> DataFrame:
    """Columns of each page: clusters of block centres, by density, in one dimension.

    A centre is a core if 3 centres lie within 0.15 of the page's width; clusters are runs of cores no
    further apart than that. Pages of fewer than 6 blocks, or 6 long ones, have one column.
    """
    width = F.lit(600.0) if width is None else width
    pages = blocks.groupBy(*PAGE).agg(F.count("*").alias("n"))
    long_ = blocks.filter(F.length(_bare()) >= 30).select(*PAGE, (((F.col("x0") + F.col("x1")) / 2) / width).alias("x"))
    near = F.expr("count(*) OVER (PARTITION BY doc_id, page_index ORDER BY x RANGE BETWEEN 0.15D PRECEDING AND 0.15D FOLLOWING)")
    order = Window.partitionBy(*PAGE).orderBy("x")
    cores = long_.withColumn("k", near).withColumn("m", F.count("*").over(Window.partitionBy(*PAGE))).filter("k >= 3 and m >= 6")
    new = F.coalesce(F.col("x") - F.lag("x").over(order) > 0.15, F.lit(True))
    found = cores.withColumn("new", new.cast("int")).groupBy(*PAGE).agg(F.sum("new").alias("found"))
    return pages.join(found, list(PAGE), "left").select(*PAGE, F.when(F.col("n") < 6, 1).otherwise(F.greatest(F.lit(1), F.coalesce("found", F.lit(1)))).cast("long").alias("n_columns"))


def reading_order(blocks: DataFrame, gap: float = 15.0) -> DataFrame:
    """Blocks with row and place: a gap of more than 15 between centres starts a row; rows by the first block's y0, falling; in a row by x0."""
    y = (F.col("y0") + F.col("y1")) / 2
    order = Window.partitionBy(*PAGE).orderBy("y", "block_no")
    marked = blocks.withColumn("y", y).withColumn("new", F.coalesce((F.col("y") - F.lag("y").over(order) > gap).cast("int"), F.lit(0)))
    rows = marked.withColumn("row", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.struct("block_no", "y0")).over(Window.partitionBy(*PAGE, "row"))["y0"]
    place = F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc("first"), "row", "x0", "block_no"))
    return rows.withColumn("first", first).select(*PAGE, "block_no", F.col("row").cast("long").alias("row"), place.cast("long").alias("place"))


def margin_lines(blocks: DataFrame, share: float = 0.12, normal=normal_line, longest: int = 120) -> DataFrame:
    """(doc_id, page_index, block_no, line) of blocks in the top or bottom of the used height."""
    page = Window.partitionBy(*PAGE)
    low, high = F.min(F.least("y0", "y1")).over(page), F.max(F.greatest("y0", "y1")).over(page)
    spread = blocks.withColumns({"low": low, "high": high}).withColumn("margin", (F.col("high") - F.col("low")) * share)
    edge = (F.col("y1") < F.col("low") + F.col("margin")) | (F.col("y0") > F.col("high") - F.col("margin"))
    return spread.filter(edge).select(*PAGE, "block_no", normal(F.col("text")).alias("line")).filter(F.length("line").between(2, longest))


def repeating_lines(blocks: DataFrame, share: float = 0.8) -> DataFrame:
    """(doc_id, line, n) of margin lines on at least ``share`` of a document's pages."""
    pages = blocks.groupBy("doc_id").agg(F.countDistinct("page_index").alias("pages"))
    found = margin_lines(blocks).groupBy("doc_id", "line").agg(F.count("*").alias("n"))
    return found.join(pages, "doc_id").filter(F.col("n") >= F.col("pages") * share).select("doc_id", "line", "n")


def without_repeating(blocks: DataFrame, repeating: DataFrame) -> DataFrame:
    """Blocks whose normal line doesn't begin with a repeating line of its document."""
    marks = repeating.select(F.col("doc_id").alias("__doc"), F.col("line").alias("__line"))
    return blocks.withColumn("__normal", normal_line(F.col("text"))).join(marks, (F.col("doc_id") == F.col("__doc")) & F.col("__normal").startswith(F.col("__line")), "left_anti").drop("__normal")


def without_images(blocks: DataFrame, images: DataFrame, share: float = 0.3) -> DataFrame:
    """P5: blocks of which no image (doc_id, page_index, x0, y0, x1, y1) covers more than ``share``."""
    i = images.select(*(F.col(c).alias(f"i_{c}") for c in (*PAGE, "x0", "y0", "x1", "y1")))
    side = lambda a, b: F.greatest(F.lit(0.0), F.least(f"i_{b}", b) - F.greatest(f"i_{a}", a))
    area = F.greatest((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), F.lit(1.0))
    same = (F.col("doc_id") == F.col("i_doc_id")) & (F.col("page_index") == F.col("i_page_index"))
    return blocks.join(i, same & (side("x0", "x1") * side("y0", "y1") / area > share), "left_anti")


GENERIC = ("page_num", "num_only", "page_range")


def without_patterns(blocks: DataFrame) -> DataFrame:
    """Blocks without the margin patterns that come back on 60 % of pages, twice at least; generic marks stay."""
    pages = blocks.groupBy("doc_id").agg(F.countDistinct("page_index").alias("pages"))
    found = margin_lines(blocks, 0.10, normal_pattern, 150).filter(~F.col("line").isin(*GENERIC)).groupBy("doc_id", "line").agg(F.count("*").alias("n"))
    often = found.join(pages, "doc_id").filter(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("pages") * 0.6)))
    marks = often.select(F.col("doc_id").alias("__doc"), F.col("line").alias("__line"))
    return blocks.withColumn("__normal", normal_pattern(F.col("text"))).join(marks, (F.col("doc_id") == F.col("__doc")) & (F.col("__normal") == F.col("__line")), "left_anti").drop("__normal")


def without_scraps(blocks: DataFrame) -> DataFrame:
    """Blocks of two characters or more."""
    return blocks.filter(F.length(_bare()) >= 2)


def fragmented(text: Column) -> Column:
    """P10: whether a long block is cut in many short lines; null for short blocks."""
    bare = strip(text)
    rows = F.filter(F.transform(lines(bare), strip), lambda x: x != "")
    short = F.size(F.filter(rows, lambda x: F.length(x) < 55))
    return F.when(F.length(bare) >= 80, (F.size(rows) >= 4) & (short / F.size(rows) > 0.65))


def page_metrics(blocks: DataFrame, images: DataFrame, width: float = 600.0, height: float = 800.0) -> DataFrame:
    """P8 to P11 by page: blocks, characters, column suspicion, fragmentation, large images."""
    real = blocks.filter(_bare() != "")
    long_, ratio = F.length(_bare()) >= 30, F.col("x0") / width
    frag = fragmented(F.col("text"))
    by_page = real.groupBy(*PAGE).agg(
        F.count("*").alias("n_blocks"),
        (F.sum(F.length("text")) + F.count("*") - 1).alias("n_chars"),
        F.count_if(long_).alias("n_long"),
        F.count_if(long_ & (ratio < 0.33)).alias("n_left"),
        F.coalesce(F.avg(frag.cast("double")), F.lit(0.0)).alias("fragmentation"),
    )
    area = F.greatest(F.lit(0.0), F.col("x1") - F.col("x0")) * F.greatest(F.lit(0.0), F.col("y1") - F.col("y0"))
    large = images.groupBy(*PAGE).agg(F.bool_or(area / (width * height) > 0.65).alias("large_image"), F.count("*").alias("n_images"))
    columns = (F.col("n_blocks") >= 6) & (F.col("n_long") >= 6) & (F.col("n_left") >= 3) & (F.col("n_long") - F.col("n_left") >= 3)
    return by_page.withColumn("multi_column", columns).join(large, list(PAGE), "left").select(*PAGE, "n_blocks", "n_chars", "multi_column", "fragmentation", F.coalesce("large_image", F.lit(False)).alias("large_image"), F.coalesce("n_images", F.lit(0)).alias("n_images"))


def document_metrics(blocks: DataFrame, images: DataFrame) -> DataFrame:
    """A document's metrics from its pages' and its whole text's."""
    pages = page_metrics(blocks, images)
    per_doc = pages.groupBy("doc_id").agg(F.count("*").alias("page_count"), F.avg("n_chars").alias("avg_chars"), F.avg("n_blocks").alias("avg_blocks"), F.avg(F.col("large_image").cast("double")).alias("image_ratio"), F.avg(F.col("multi_column").cast("double")).alias("column_ratio"), F.avg("fragmentation").alias("fragmentation"), F.sum("n_images").alias("n_images"))
    whole = blocks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_index", "block_no", "text"))), lambda x: x["text"]), "\n").alias("__text"))
    text = F.col("__text")
    texts = whole.select("doc_id", english_word_ratio(text).alias("english"), garbled_ratio(text).alias("garbled"), count(text, CID_LOOSE).alias("cid"), academic_marks(text)["has_references"].alias("has_references"))
    again = margin_lines(blocks).groupBy("doc_id", "line").agg(F.count("*").alias("n")).filter("n >= 2").groupBy("doc_id").agg(F.count("*").alias("repeated"))
    return per_doc.join(texts, "doc_id").join(again, "doc_id", "left").withColumn("repeated", F.coalesce("repeated", F.lit(0)))


def penalties(encrypted: Column | None = None, similarity: Column | None = None) -> list[tuple[Column, Column, str]]:
    """(condition, points, problem) over the columns of :func:`document_metrics`."""
    c, none = F.col, F.lit(False)
    return [
        (none if encrypted is None else F.coalesce(encrypted, F.lit(False)), F.lit(30), "ENCRYPTED"),
        (c("page_count") == 0, F.lit(50), "NO_PAGES"),
        (c("avg_chars") < MIN_CHARS, F.lit(25), "FEW_CHARACTERS"),
        (c("garbled") > MAX_GARBLED, F.lit(20), "GARBLED"),
        (c("cid") > 0, F.least(F.lit(20), c("cid") * 2), "CID_MARKERS"),
        (c("english") < MIN_ENGLISH, F.lit(15), "LITTLE_ENGLISH"),
        (c("image_ratio") > MAX_IMAGES, F.lit(25), "LARGE_IMAGES"),
        (c("column_ratio") > MAX_COLUMNS, F.lit(15), "COLUMNS"),
        (c("repeated") > F.greatest(F.lit(2), F.floor(c("page_count") / 3)), F.lit(5), "REPEATED_LINES"),
        (c("fragmentation") > MAX_FRAGMENTS, F.lit(10), "FRAGMENTED"),
        (none if similarity is None else F.coalesce(similarity < 0.6, F.lit(False)), F.lit(10), "EXTRACTORS_DIFFER"),
    ]


def level(score: Column) -> Column:
    """P13."""
    return F.when(score >= 90, "VERY_CLEAN").when(score >= 75, "CLEAN").when(score >= 60, "NEEDS_CLEANING").otherwise("NOT_RECOMMENDED")


def cleanliness(metrics: DataFrame, encrypted: Column | None = None, similarity: Column | None = None) -> DataFrame:
    """Score, problems, level, acceptance and advice.

    encrypted, similarity: whether a document is encrypted, and how alike two extractors' texts of it are (columns over
    ``metrics``; None: not encrypted, not compared).
    """
    rules = penalties(encrypted, similarity)
    points = sum((F.when(c, p).otherwise(0) for c, p, _ in rules), F.lit(0))
    out = metrics.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - points)).cast("double"))
    out = out.withColumn("problems", F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, _, n in rules)))).withColumn("level", level(F.col("score")))
    c = F.col
    fine = c("level").isin("VERY_CLEAN", "CLEAN") & (c("avg_chars") >= MIN_CHARS) & (c("garbled") <= MAX_GARBLED) & (c("cid") == 0) & (c("image_ratio") <= MAX_IMAGES) & (c("column_ratio") <= MAX_COLUMNS)
    if encrypted is not None:
        fine &= ~F.coalesce(encrypted, F.lit(False))
    return out.withColumn("accepted", fine).withColumn("advice", advice())


ADVICE = (("avg_chars", "<", MIN_CHARS, "run text recognition first"), ("garbled", ">", MAX_GARBLED, "extract again with another tool"), ("cid", ">", 0, "embed the fonts' character maps"), ("image_ratio", ">", MAX_IMAGES, "treat image pages apart"), ("column_ratio", ">", MAX_COLUMNS, "split columns before translation"))


def advice() -> Column:
    """What to do about the limits that are passed."""
    over = lambda n, op, x: F.col(n) < x if op == "<" else F.col(n) > x
    return F.array_compact(F.array(*(F.when(over(n, op, x), F.lit(text)) for n, op, x, text in ADVICE)))


# --- tables -------------------------------------------------------------------------------------


def table_rows(cells: list[tuple[float, float, float, float, str]], tolerance: float = 10.0) -> list[list[int]]:
    """Rows of cells, by distance to the row's first y0; cells by y0."""
    rows: list[list[int]] = []
    for i in sorted(range(len(cells)), key=lambda i: (cells[i][1], cells[i][0])):
        if rows and abs(cells[i][1] - cells[rows[-1][0]][1]) <= tolerance:
            rows[-1].append(i)
        else:
            rows.append([i])
    return rows


def table_grid(cells: list[tuple[float, float, float, float, str]], gap: float = 20.0) -> list[list[str]] | None:
    """The grid of a page's blocks, if two rows or more have two columns or more."""
    rows = [r for r in table_rows(cells) if len(r) >= 2]
    if len(rows) < 2:
        return None
    starts: list[float] = []
    for x in sorted(cells[i][0] for r in rows for i in r):
        if not starts or x - starts[-1] > gap:
            starts.append(x)
    if len(starts) < 2:
        return None
    grid = [[""] * len(starts) for _ in rows]
    for k, r in enumerate(rows):
        for i in r:
            column = max(j for j, s in enumerate(starts) if cells[i][0] >= s)
            grid[k][column] = " ".join(x for x in (grid[k][column], cells[i][4].strip()) if x)
    return grid


def grid_markdown(grid: list[list[str]]) -> str:
    line = lambda r: "| " + " | ".join(c.replace("|", r"\|").replace("\n", " ") for c in r) + " |"
    return "\n".join([line(grid[0]), "| " + " | ".join("---" for _ in grid[0]) + " |", *map(line, grid[1:])])


def tables(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_index, n_rows, n_columns, markdown) of pages whose blocks form a table."""
    pages = blocks.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("x0", "y0", "x1", "y1", "text"))).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, page, cells in zip(*batch.columns, strict=True):
                grid = table_grid([tuple(c.values()) for c in cells.as_py()])
                if grid:
                    out.append((doc.as_py(), page.as_py(), len(grid), len(grid[0]), grid_markdown(grid)))
            columns = zip(*out, strict=True) if out else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "page_index", "n_rows", "n_columns", "markdown"])

    return pages.select(F.col("doc_id").cast("long"), F.col("page_index").cast("long"), "b").mapInArrow(run, "doc_id long, page_index long, n_rows long, n_columns long, markdown string")


# --- pages --------------------------------------------------------------------------------------

#: fixed values: words that leave a sentence open, and words that go on with one
OPEN_WORDS = "the|and|or|but|in|on|at|to|for|of|with"
GOING_ON = "and|or|but|however|therefore|moreover|furthermore|which|that|this|these|those|also|too|as well"


def ends_open(text: Column) -> Column:
    """Whether a page's text ends inside a sentence."""
    tail = strip(F.substring(strip(text), -200, 200))
    closed, words = tail.rlike(r"[.!?]\s*$"), F.size(F.split(tail, r"\s+"))
    open_ = tail.rlike(rf"(?i)\b({OPEN_WORDS})\s*$") | tail.rlike(r"[\p{Ll}-]$") | (~tail.rlike("[.!?\"')】》]$") & (words > 3))
    return (F.length(strip(text)) >= 50) & ~closed & open_


def goes_on(text: Column) -> Column:
    """Whether a page's text begins inside a sentence."""
    return (F.length(strip(text)) >= 20) & (strip(text).rlike(r"^\p{Ll}") | strip(text).rlike(rf"(?i)^({GOING_ON})"))


def joined_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, first_page, last_page, text): runs of pages (doc_id, page_index, text) whose breaks cut a sentence."""
    order = Window.partitionBy("doc_id").orderBy("page_index")
    real = pages.withColumn("text", strip(F.col("text"))).filter("text <> ''")
    breaks = ~(F.coalesce(F.lag(ends_open(F.col("text"))).over(order), F.lit(False)) & goes_on(F.col("text")))
    runs = real.withColumn("b", breaks.cast("int")).withColumn("run", F.sum("b").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_index", "text"))), lambda x: x["text"]), " ")
    return runs.groupBy("doc_id", "run").agg(F.min("page_index").alias("first_page"), F.max("page_index").alias("last_page"), whole.alias("text")).drop("run")


def text_fits(text: Column, width: Column, height: Column, size: Column) -> Column:
    """Whether a text fits a rectangle at a font size, by mean character width."""
    per_line = F.greatest(F.lit(1), F.floor(width / F.greatest(F.lit(1.0), size * 0.58)))
    needed = F.aggregate(F.transform(lines(text), strip), F.lit(0).cast("long"), lambda a, x: a + F.greatest(F.lit(1), F.ceil(F.length(x) / per_line)).cast("long"))
    needed = F.greatest(needed, F.lit(1))
    return needed * size * 1.2 <= height


def fitting_size(source: Column, target: Column, width: Column, height: Column) -> Column:
    """The largest font size, in halves from the estimated one, at which the target fits; 4.5 at least."""
    count_ = F.size(F.filter(lines(source), lambda x: strip(x) != ""))
    base = F.greatest(F.lit(5.0), F.least(F.lit(12.0), height / F.greatest(F.lit(1), count_) * 0.72))
    ratio = F.length(source) / F.greatest(F.lit(1), F.length(target))
    first = F.greatest(F.lit(4.5), F.least(base, base * F.greatest(F.lit(0.55), F.least(F.lit(1.1), ratio))))
    sizes = F.transform(F.sequence(F.lit(0), F.floor((first - 4.5) / 0.5).cast("int")), lambda k: first - k * 0.5)
    return F.coalesce(F.array_max(F.filter(sizes, lambda s: text_fits(target, width, height, s))), F.lit(4.5))


def fuzzy_lookup(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(id, text) with the translation of known (place, source, target): exact, then by half, then by first words.

    Texts of more than 50 characters match a known text that begins with their first half or ends with
    their second; else the first five words decide. Each tier is an equality join on a derived key, so
    none is a nested loop; in a tier the first known text wins.
    """
    first = lambda x: F.array_join(F.slice(F.filter(F.split(x, r"\s+"), lambda w: w != ""), 1, 5), " ")
    text = F.col("text")
    long_ = wanted.filter(F.length("text") > 50)
    # halves have 25 characters or more, so their outer 25 are an equality key
    head, tail = F.expr("left(text, cast(floor(length(text) / 2) as int))"), F.expr("right(text, length(text) - cast(floor(length(text) / 2) as int))")
    source = F.col("source")
    tiers = [
        (wanted.select("id", text.alias("key"), F.lit("").alias("half")), source, F.lit(True)),
        (long_.select("id", F.expr("left(text, 25)").alias("key"), head.alias("half")), F.expr("left(source, 25)"), F.startswith(source, F.col("half"))),
        (long_.select("id", F.expr("right(text, 25)").alias("key"), tail.alias("half")), F.expr("right(source, 25)"), F.endswith(source, F.col("half"))),
        (wanted.select("id", first(text).alias("key"), F.lit("").alias("half")), first(source), F.lit(True)),
    ]
    # a key whose places are all alike good keeps its first place only, before the join
    least = lambda key: known.select("place", "target", "source", key.alias("key")).groupBy("key").agg(F.min(F.struct("place", "target", "source")).alias("x")).select("key", "x.*")
    hits = [a.join(least(key) if k in (1, 4) else known.select("place", "target", "source", key.alias("key")), "key").filter(same).groupBy("id").agg(F.min(F.struct("place", "target")).alias("x")).select("id", F.lit(k).alias("tier"), "x.target") for k, (a, key, same) in enumerate(tiers, 1)]
    best = reduce(lambda a, b: a.unionByName(b), hits).groupBy("id").agg(F.min(F.struct("tier", "target")).alias("x"))
    return wanted.join(best, "id", "left").select("id", "text", "x.tier", "x.target")


def page_blocks(blocks: DataFrame, images: DataFrame) -> DataFrame:
    """A document's blocks in reading order, without margins, image text and scraps.

    Blocks of a page are put in columns' order only where a fifth of the document's pages has columns.
    """
    kept = without_scraps(without_images(without_repeating(blocks, repeating_lines(blocks)), images))
    ratio = document_metrics(blocks, images).select("doc_id", "column_ratio")
    placed = kept.join(reading_order(kept), [*PAGE, "block_no"]).join(ratio, "doc_id")
    place = F.when(F.col("column_ratio") > 0.2, F.col("place")).otherwise(F.col("block_no"))
    return placed.withColumn("order", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_index", place, "block_no"))).select("doc_id", "order", "page_index", "block_no", "text")
