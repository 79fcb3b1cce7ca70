"""Masking of spans that must survive a text's transformation, as column expressions.

Spark gives no match offsets, so they are summed from the lengths of the gaps and matches of a pattern.
Overlaps are resolved and placeholders put in by folds over the sorted matches of one text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: kinds of protected spans, their patterns, and whether only group 1 (before the last character) counts
PATTERNS = (
    ("CODE_BLOCK", r"```[\s\S]*?```|~~~[\s\S]*?~~~", False),
    ("HTML_BLOCK", r"<([A-Za-z][A-Za-z0-9:-]*)(?:\s[^>]*)?>[\s\S]*?</\1>", False),
    ("HTML_TAG", r"<[^>\n]+>", False),
    ("INLINE_CODE", r"`[^`\n]+`", False),
    ("IMAGE_PATH", r"!\[[^\]]*\]\(([^)\s]+)\)", True),
    ("LINK_TARGET", r"(?<!!)\[[^\]]+\]\(([^)\s]+)\)", True),
    ("URL", r"https?://[^\s)>\]]+", False),
    ("REF", r"\[\^?[A-Za-z0-9_.:-]+\]", False),
    ("API_PATH", r"\b(?:GET|POST|PUT|PATCH|DELETE)\s+/[A-Za-z0-9_./{}:-]+", False),
    ("FILE_PATH", r"(?<!\w)(?:[A-Za-z]:\\[^\s`]+|/[A-Za-z0-9_./-]+|\./[A-Za-z0-9_./-]+)", False),
)
PLACEHOLDER = r"__LT_[A-Z_]+_\d{6}__"
_MATCH = "array<struct<start:int,end:int,no:int>>"
_SPAN = "array<struct<placeholder:string,span_type:string,original_text:string,start_offset:int,end_offset:int>>"


def offsets(text: Column, pattern: str, group: bool = False) -> Column:
    """(start, end, hit) of every match; with ``group``, of group 1, which ends a character before the match."""
    regex, kind = F.lit(pattern), "struct<at:int,out:array<struct<start:int,end:int,hit:string>>>"
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, regex, F.lit(0)).alias("hit"), F.regexp_extract_all(text, regex, F.lit(1 if group else 0)).alias("part"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x["gap"]) + F.length(x["hit"])
        stop = end - 1 if group else end
        found = F.struct((stop - F.length(x["part"])).alias("start"), stop.alias("end"), x["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(found)).alias("out")).cast(kind)

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,hit:string>>").alias("out")).cast(kind)
    found = F.aggregate(F.filter(rows, lambda x: x["hit"].isNotNull()), zero, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:int,end:int,hit:string>>"))


def _ranked(no: int) -> Callable[[Column], Column]:
    """A match as (start, negative length, kind, end), the order in which matches are taken."""
    return lambda x: F.struct(x["start"].alias("start"), (x["start"] - x["end"]).alias("shorter"), F.lit(no).alias("no"), x["end"].alias("end"))


def matches(text: Column) -> Column:
    """Matches of all kinds, sorted by start, longest first, then kind."""
    every = []
    for no, (name, pattern, group) in enumerate(PATTERNS):
        found = offsets(text, "(?U)" + pattern, group)
        if name == "HTML_BLOCK":
            found = F.filter(found, lambda x: ~F.contains(x["hit"], F.lit("```")))
        every.append(F.transform(found, _ranked(no)))
    order = F.array_sort(F.concat(*every))
    return F.transform(order, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["no"].alias("no"))).cast(_MATCH)


def accepted(found: Column) -> Column:
    """Matches that don't begin before the last accepted one ends."""
    kind = f"struct<last:int,out:{_MATCH}>"

    def step(acc: Column, x: Column) -> Column:
        taken = F.struct(x["end"].alias("last"), F.concat(acc["out"], F.array(x)).alias("out")).cast(kind)
        return F.when(x["start"] < acc["last"], acc).otherwise(taken).cast(kind)

    zero = F.struct(F.lit(-1).alias("last"), F.array().cast(_MATCH).alias("out")).cast(kind)
    return F.aggregate(found, zero, step, lambda acc: acc["out"])


def masked(text: Column) -> Column:
    """(protected, spans): the text with placeholders, and what they stand for."""
    kind = f"struct<at:int,protected:string,spans:{_SPAN}>"
    names = F.array(*(F.lit(n) for n, _, _ in PATTERNS))

    def step(acc: Column, x: Column) -> Column:
        name = F.element_at(names, x["no"] + 1)
        placeholder = F.format_string("__LT_%s_%06d__", name, F.size(acc["spans"]) + 1)
        gap = text.substr(acc["at"] + 1, x["start"] - acc["at"])
        span = F.struct(placeholder.alias("placeholder"), name.alias("span_type"), text.substr(x["start"] + 1, x["end"] - x["start"]).alias("original_text"), x["start"].alias("start_offset"), x["end"].alias("end_offset"))
        return F.struct(x["end"].alias("at"), F.concat(acc["protected"], gap, placeholder).alias("protected"), F.concat(acc["spans"], F.array(span)).alias("spans")).cast(kind)

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("protected"), F.array().cast(_SPAN).alias("spans")).cast(kind)
    return F.aggregate(accepted(matches(text)), zero, step, lambda acc: F.struct(F.concat(acc["protected"], text.substr(acc["at"] + 1, F.length(text))).alias("protected"), acc["spans"].alias("spans")))


def restored(text: Column, spans: Column) -> Column:
    return F.aggregate(spans, text.cast("string"), lambda t, s: F.replace(t, s["placeholder"], s["original_text"]).cast("string"))


def placeholders(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PLACEHOLDER), F.lit(0)))


def marked_parts(text: Column, marker: str) -> Column:
    """Marker to the text up to the next one, stripped; the last of equal markers wins."""
    text = F.coalesce(text, F.lit(""))
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(marker), F.lit(0)).alias("k"), F.slice(F.split(text, marker, -1), 2, 2**30).alias("v"))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], F.regexp_replace(x["v"], r"(?U)^\s+|\s+$", ""))))


def chosen_text(parts: Column, marker: Column, restored_text: Column, blocks: Column, source: Column, draft: Column) -> Column:
    """A block's text: its marked part; a lone block's whole text; the source in drafts; else null."""
    return F.coalesce(F.try_element_at(parts, marker), F.when((blocks == 1) & (F.size(parts) == 0), restored_text), F.when(draft, source))
