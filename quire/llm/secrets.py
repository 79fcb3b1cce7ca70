"""Operator 7 [native]: secret candidates and their corpus-wide ownership, in DataFrame functions only.

Spans. Three base kinds are found in whole texts, leftmost and non-overlapping for each kind, in one pass
over the texts; what was found is written, and nothing after it reads a text again (``redact`` once more, to cut). Spark
has no function that returns match offsets, so an offset is the running sum of the lengths of the gaps
(``split``) and matches (``regexp_extract_all``) before it, by a window over a distinct text's matches. Offsets count code points.

Ownership. Every candidate's value is hashed; (hash, owner, repository) rows are made distinct before
they are counted by hash, so a value that a third of all documents repeat meets as one row for each
owner and repository, not one for each document. A value with ``EXAMPLE_OWNERS`` owners or more, or in
``EXAMPLE_REPOS`` repositories or more whoever owns them, is a widely copied example; any other value that looks random (``LOOKS``
of length and variety) is an owner-specific, live-looking credential; the rest stays plain. Two further kinds of spans
say so: ``live`` and ``example`` span the value alone.

Spans and marks are made once for each distinct text; documents meet them by the hash of their text in a plain
sort-merge join, which adaptive execution splits where one text is hot. Documents without candidates never enter it.

Null texts are empty. Null owners and repositories count as one owner or repository named null.
Repeated rows get the same result each; ids may be null or repeated. Extra columns are ignored by ``scan`` and kept by ``redact``.
Cutting costs the length of a text for each live span in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import Stage, whole_text

#: fixed values: the base patterns; a base match shorter than the least length is dropped
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: the runs of these two are maximal, so the least length can stand in the pattern
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "live", "example")
ASSIGN_LEAST = 8
#: A value with so many distinct owners, or in so many distinct repositories, is a copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 6
#: A live-looking value has at least so many characters, of which so many differ, digits and letters.
LOOKS = (8, 5)

_HIT = "struct<kind:int,i:int,gap:int,length:int,value:string>"


def _hits(text: Column, kind: int, pattern: str, group: int) -> Column:
    """The kind's matches as an array of (kind, number, length of the gap before, length, value); value is the given group."""
    regex = F.lit(pattern)
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, regex, F.lit(0)).alias("hit"), F.regexp_extract_all(text, regex, F.lit(group)).alias("value"))
    # the last gap has no match after it: there the match is null
    each = F.transform(F.filter(zipped, lambda x: x["hit"].isNotNull()), lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("length"), x["value"].alias("value")))
    return F.when(text.rlike(pattern), each.cast(f"array<{_HIT}>")).otherwise(F.array().cast(f"array<{_HIT}>"))


def _has_base(text: Column) -> Column:
    return text.rlike(ASSIGN) | text.rlike(ACCESS) | text.rlike(HEX)


def looks_live(value: Column) -> Column:
    length, variety = LOOKS
    return (F.length(value) >= length) & (F.size(F.array_distinct(F.split(value, ""))) >= variety) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def _least(span: Column) -> Column:
    """Whether a hit is long enough; the patterns of the other kinds see to that themselves."""
    return (span["kind"] != 0) | (F.length(span["value"]) >= ASSIGN_LEAST)


def found_in(docs: DataFrame, id_col: str, text_col: str, owner: Column, repo: Column) -> DataFrame:
    """(id, owner, repo, key, hits) of every document; key stands for the text, null where nothing was found."""
    rows = docs.select(F.col(id_col), whole_text(text_col).alias("__text"), owner.cast("string").alias("__owner"), repo.cast("string").alias("__repo"))
    text = F.col("__text")
    rows = rows.withColumn("__hits", F.concat(_hits(text, 0, ASSIGN, 2), _hits(text, 1, ACCESS, 0), _hits(text, 2, HEX, 0)))
    some = F.exists("__hits", _least)
    return rows.select(F.col(id_col), F.col("__owner").alias("owner"), F.col("__repo").alias("repo"), F.when(some, F.sha2("__text", 256)).alias("key"), F.when(some, F.col("__hits")).alias("hits"))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repos) of every candidate value of the corpus."""
    values = F.array_distinct(F.transform(F.filter("hits", _least), lambda x: F.sha2(x["value"].cast("binary"), 256)))
    each = found.filter("key is not null").select(F.coalesce("owner", F.lit("\0")).alias("owner"), F.coalesce("repo", F.lit("\0")).alias("repo"), F.explode(values).alias("hash"))
    by_owner = each.distinct().groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repos"))


def classed(found: DataFrame, counted: DataFrame, stage: Stage) -> DataFrame:
    """Of every distinct text with candidates (key, kind, start, end, n_owners, n_repos): base spans, live and example spans."""
    texts = found.filter("key is not null").groupBy("key").agg(F.first("hits").alias("hits"))
    hits = texts.select("key", F.explode("hits").alias("hit")).select("key", "hit.*")
    end = F.sum(F.col("gap") + F.col("length")).over(Window.partitionBy("key", "kind").orderBy("i"))
    spans = hits.withColumn("end", end).filter(f"kind <> 0 or length(value) >= {ASSIGN_LEAST}")
    spans = spans.select("key", "kind", (F.col("end") - F.col("length")).alias("start"), "end", "value", F.sha2(F.col("value").cast("binary"), 256).alias("hash"))
    spans = stage.keep(spans.join(ownership(counted), "hash", "left"), "spans")
    example = (F.coalesce("n_owners", F.lit(0)) >= EXAMPLE_OWNERS) | (F.coalesce("n_repos", F.lit(0)) >= EXAMPLE_REPOS)
    marks = spans.withColumn("kind", F.when(example, F.lit(4)).when(looks_live(F.col("value")), F.lit(3))).filter("kind is not null")
    marks = marks.select("key", "kind", (F.col("end") - F.length("value")).alias("start"), "end", "n_owners", "n_repos").distinct()
    return spans.select("key", "kind", "start", "end", "n_owners", "n_repos").unionByName(marks)


def _joined(spans: Column) -> Column:
    """kind:start:end of spans (start, kind, end), comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, owner: Column, repo: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, n_assign, n_access, n_hex, n_live, n_example, base_sha256, spans, most_owners, most_repos.

    The last two: the most owners and repositories that one of its candidates has in the corpus (0 without candidates).
    """
    stage = Stage(docs.sparkSession, "secrets")
    found = stage.keep(found_in(docs, id_col, text_col, owner, repo), "found")
    each = classed(found, found, stage).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("all"), F.max("n_owners").alias("most_owners"), F.max("n_repos").alias("most_repos"))
    base = F.filter("all", lambda x: x["kind"] < 3)
    count = lambda k: F.size(F.filter("all", lambda x: x["kind"] == k)).cast("long")
    told = [*(count(k).alias(f"n_{n}") for k, n in enumerate(KINDS)), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"), "most_owners", "most_repos"]
    each = stage.keep(each.select("key", *told), "texts")
    names = each.columns[1:]
    empty = [*(F.lit(0).cast("long").alias(f"n_{n}") for n in KINDS), F.sha2(F.lit(""), 256).alias("base_sha256"), F.lit("").alias("spans"), F.lit(0).cast("long").alias("most_owners"), F.lit(0).cast("long").alias("most_repos")]
    some = found.filter("key is not null").select(F.col(id_col).alias("__id"), F.col("key")).join(each, "key").select(F.col("__id").alias(id_col), *names)
    return some.unionByName(found.filter("key is null").select(id_col, *empty))


def redact(docs: DataFrame, owner: Column, repo: Column, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text", corpus: DataFrame | None = None) -> DataFrame:
    """``docs`` with every live span replaced; documents without any stay as they are, null too.

    ``corpus``: rows like ``docs`` whose owners and repositories are counted, where ``docs`` is a selection of it.
    All columns are kept as they are but the text (a length column is the caller's to renew).
    """
    stage = Stage(docs.sparkSession, "redact")
    found = stage.keep(found_in(docs, id_col, text_col, owner, repo), "found")
    counted = found if corpus is None else stage.keep(found_in(corpus, id_col, text_col, owner, repo), "corpus")
    live = classed(found, counted, stage).filter("kind = 3").select("key", "start", "end").distinct()
    # spans that overlap are cut as one
    before = Window.partitionBy("key").orderBy("start", "end")
    live = live.withColumn("group", F.sum(F.when(F.col("start") < F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)).over(before))
    live = live.groupBy("key", "group").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    live = stage.keep(live.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("live")).select(F.col("key").alias("__key"), F.col("live").alias("__live")), "live")
    text = whole_text(text_col)
    clean = docs.filter(~_has_base(text))
    keyed = docs.filter(_has_base(text)).join(live, F.sha2(text, 256) == F.col("__key"), "left")

    def piece(x: Column, i: Column) -> Column:
        begin = F.when(i == 0, F.lit(0).cast("long")).otherwise(F.try_element_at(F.col("__live"), i)["end"])  # element_at counts from 1
        return F.concat(text.substr((begin + 1).cast("int"), (x["start"] - begin).cast("int")), F.lit(mark))

    rest = text.substr((F.element_at("__live", -1)["end"] + 1).cast("int"), F.length(text))
    cut = F.concat(F.array_join(F.transform("__live", piece), ""), rest)
    dirty = keyed.withColumn(text_col, F.when(F.col("__live").isNotNull(), cut).otherwise(F.col(text_col))).select(*docs.columns)
    return clean.unionByName(dirty)
