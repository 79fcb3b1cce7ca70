"""Operator 9: mixing sources to target weights by iterative proportional fitting.

A document weighs the tokens that the tokenizer of ``TOKENIZER``, which also packs the sequences, makes of its
whole text. Weights are summed by cell (source, language, topic). Raking scales the cells so that the shares
of every source, language and topic meet their targets, one dimension after the other, until nothing
moves. The output is to have ``KEEP`` of all tokens and no document twice, so a cell's share is bounded
by what it has; a bounded cell gives all it has, and the others of its values make up for it as far as they
can. Where targets can't be met together, a cell still keeps ``LEAST`` of its share. A cell's calibrated tokens over its tokens are the probability with which each of its documents
stays. The draw is a hash of the id and the text, so it repeats at any partitioning.

Targets that are not given are the square roots of the shares as they are (``flatten``), which lifts
small sources and languages without ruling out large ones. A target above what its value has is
lowered to that, and one for a value without tokens left out; the other targets take up the rest. A value without a target gets none and its
documents go; null is a value like any other.

Cells are as many as there are combinations of values that occur: the table of cells is collected only after its
count is checked against ``CELLS``; above that, the same raking, with the same rounds and the same end, runs as DataFrame steps,
targets included, so a dimension may have any number of values. Tokens of a cell are summed before they are shuffled, so a hot
source costs one row a task.

Null or empty texts weigh one token, so every document belongs to a cell. Repeated rows are drawn
alike. An empty table gives an empty result. Other columns are kept.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Stage, whole_text
from quire.llm.pretoken import byte_pair_ids

#: The tokenizer file that weighs, and the pre-tokens that a worker remembers for it.
TOKENIZER, MEMO = "byte_bpe_50k.json", 300_000
CLOSE, ROUNDS, CELLS = 1e-9, 200, 100_000
#: Share of all tokens that the output is to have.
KEEP = 0.7
#: A cell whose values all have targets keeps at least this part of its share, where targets can't be met together.
LEAST = 0.2
#: fixed values: marks of topics in a text; a text has the topic whose marks are the most, by share of words
TOPICS = {
    "contact": r"[\w.+-]+@[\w-]+\.\w+|https?://|www\.|\(\d{3}\)|\d{3}[- ]\d{4}",
    "code": r"[{};=<>\\]|</|\(\)|::|->",
    "numbers": r"\d+",
    "listing": r"[|#*%&$]{1,}",
}
#: A topic needs this share of a text's words.
TOPIC_SHARE = 0.1
#: The patterns above, made cheap: ``contact`` tries an e-mail address only where its run of characters starts or what is left
#: of one does; without the words in ``LINKS`` only its telephone numbers can match; every match of ``code`` is one of ``CODE``.
CONTACT = re.compile(r"(?:(?<![\w.+-])|(?<=\w)(?=[.+-])|(?<=\d{3}[- ]\d{4}))[\w.+-]++@[\w-]+\.\w+|https?://|www\.|\(\d{3}\)|\d{3}[- ]\d{4}", re.ASCII)
PHONE = re.compile(r"[(\d](?:(?<=\()\d{3}\)|(?<=\d)\d{2}[- ]\d{4})", re.ASCII)
LINKS = ("@", "://", "www.")
CODE = ("{", "}", ";", "=", "<", ">", "\\", "()", "::")
#: For runs of characters in UTF-8: 1 for a byte of the class, 0 for others; and all digits as one, to see where telephone numbers can be.
RUNS = {name: bytes(b in chars for b in range(256)) for name, chars in (("numbers", b"0123456789"), ("listing", b"|#*%&$"), ("words", bytes({*range(256)} - {*b" \t\n\r\v\f"})))}
DIGITS, PHONES = bytes.maketrans(b"123456789", b"0" * 9), (b"(000)", b"000-0000", b"000 0000")
NO_TOPIC = "prose"


def token_weight(text: Column) -> Column:
    """The tokens of the whole text, at least one."""
    path, memo = public_tokenizers.path(TOKENIZER), MEMO

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        encoder = byte_pair_ids(path, memo=memo)
        return pa.array([max(1, len(encoder.encode(x.as_py())) // encoder.width) for x in texts], pa.int64())

    return count(text)


def runs(raw: bytes, name: str) -> int:
    """The longest runs of characters of a class of ``RUNS``: its ones after a zero."""
    ones = raw.translate(RUNS[name])
    return ones.count(b"\0\1") + ones.startswith(b"\1")


def marks(text: str) -> dict[str, int]:
    """The matches of each of ``TOPICS`` in a text; the digits of a contact, such as a telephone number, aren't numbers too."""
    raw = text.encode("utf-8", "surrogatepass")
    linked, plain, contacts = any(x in text for x in LINKS), raw.translate(DIGITS), 0
    rest = raw
    if linked or any(x in plain for x in PHONES):
        rest, contacts = (CONTACT if linked else PHONE).subn(" ", text)
        rest = rest.encode("utf-8", "surrogatepass")
    return {"contact": contacts, "code": sum(map(text.count, CODE)), "numbers": runs(rest, "numbers"), "listing": runs(raw, "listing")}


def topic_of(text: Column) -> Column:
    """The topic whose marks are the most, if they are ``TOPIC_SHARE`` of the words; ties go to the last name; without any, ``NO_TOPIC``."""

    @F.arrow_udf("string")
    def topic(texts: pa.Array) -> pa.Array:
        out = []
        for x in texts:
            words = max(1, runs((value := x.as_py() or "").encode(), "words"))  # bytes: ASCII white space only
            n, name = max((n, name) for name, n in marks(value).items())
            out.append(name if n >= TOPIC_SHARE * words else NO_TOPIC)
        return pa.array(out, pa.string())

    return topic(text)


def cells(rows: DataFrame, dims: list[str], weight: str) -> DataFrame:
    """(*dims, tokens) by cell."""
    return rows.groupBy(*dims).agg(F.sum(weight).cast("double").alias("tokens"))


def flatten(shares: dict) -> dict:
    """Targets from shares: their square roots, scaled to 1."""
    root = {k: v**0.5 for k, v in shares.items()}
    total = sum(root.values())
    return {k: v / total for k, v in root.items()}


def attainable(target: dict, most: dict) -> dict:
    """The target's shares, none above what its value has; the others take up the rest in proportion."""
    want = {v: max(0.0, float(x)) for v, x in target.items() if v in most}
    full: dict = {}
    while want:
        left, total = 1.0 - sum(full.values()), sum(want.values())
        if total <= 0 or left <= 0:
            full |= dict.fromkeys(want, 0.0)
            break
        scaled = {v: x * left / total for v, x in want.items()}
        over = {v: most[v] for v, x in scaled.items() if x > most[v]}
        if not over:
            return full | scaled
        full |= over
        want = {v: x for v, x in want.items() if v not in over}
    return full


def rake(keys: list[tuple], tokens: np.ndarray, targets: list[dict], keep: float = KEEP) -> np.ndarray:
    """Cell shares of the output that meet the targets, none above what the cell has."""
    total = max(float(tokens.sum()), 1e-300)
    w, most, least = tokens / total, tokens / total / keep, LEAST * tokens / total
    for d, target in enumerate(targets):
        least = least * np.array([target.get(k[d], 0.0) > 0 for k in keys])
    index, goal = [], []
    for d, target in enumerate(targets):
        values = sorted({k[d] for k in keys}, key=lambda v: (v is None, str(v)))
        place = {v: i for i, v in enumerate(values)}
        index.append(np.array([place[k[d]] for k in keys], np.int64))
        goal.append(np.array([target.get(v, 0.0) for v in values], float))
    for _ in range(ROUNDS):
        before = w
        for at, want in zip(index, goal, strict=True):
            have = np.bincount(at, w, len(want))
            factor = np.divide(want, have, out=np.zeros_like(want), where=have > 0)
            w = np.clip(w * factor[at], least, most)
        if np.abs(w - before).max(initial=0) <= CLOSE:
            break
    return w


def goal_frames(cell: DataFrame, name: str, target: dict | None, keep: float, stage: Stage) -> DataFrame:
    """(value, goal): ``attainable`` of the target, or of the square roots of the shares, in DataFrame steps."""
    spark = cell.sparkSession
    have = cell.groupBy(F.col(name).alias("value")).agg(F.sum("tokens").alias("t"))
    total = cell.agg(F.sum("tokens").alias("t")).first()["t"] or 1.0
    if target is None:
        have = have.withColumn("want", F.sqrt(F.col("t") / total))
    else:
        given = spark.createDataFrame([(v, max(0.0, float(x))) for v, x in target.items()], f"given {cell.schema[name].dataType.simpleString()}, want double")
        have = have.join(given, F.col("value").eqNullSafe(F.col("given")), "left").select("value", "t", F.coalesce("want", F.lit(0.0)).alias("want"))
    now, k = stage.keep(have.select("value", "want", (F.col("t") / total / keep).alias("most"), F.lit(None).cast("double").alias("goal")), f"goal-{name}-0"), 0
    while True:
        sums = now.agg(F.coalesce(F.sum("goal"), F.lit(0.0)).alias("full"), F.coalesce(F.sum(F.when(F.col("goal").isNull(), F.col("want"))), F.lit(0.0)).alias("want")).first()
        left = 1.0 - sums["full"]
        if sums["want"] <= 0 or left <= 0:
            return now.select("value", F.coalesce("goal", F.lit(0.0)).alias("goal"))
        scaled = F.col("want") * (left / sums["want"])
        over = F.col("goal").isNull() & (scaled > F.col("most"))
        if now.filter(over).isEmpty():
            return now.select("value", F.coalesce("goal", scaled).alias("goal"))
        k += 1
        now = stage.keep(now.withColumn("goal", F.when(over, F.col("most")).otherwise(F.col("goal"))), f"goal-{name}-{k}")


def rake_frames(cell: DataFrame, dims: list[str], goals: list[DataFrame], stage: Stage, keep: float = KEEP, rounds: int = ROUNDS) -> DataFrame:
    """``rake`` in DataFrame steps: (*dims, tokens, w); for more cells than the driver may hold. goals: (value, goal) of each dimension."""
    total = cell.agg(F.sum("tokens").alias("t")).first()["t"] or 1.0
    now, least = cell, F.lit(LEAST) * F.col("tokens") / total
    for d, (dim, goal) in enumerate(zip(dims, goals, strict=True)):
        now = now.join(goal.select(F.col("value").alias("__value"), F.col("goal").alias(f"__goal_{d}")), F.col(dim).eqNullSafe(F.col("__value")), "left").drop("__value")
        now = now.withColumn(f"__goal_{d}", F.coalesce(f"__goal_{d}", F.lit(0.0)))
        least = F.when(F.col(f"__goal_{d}") > 0, least).otherwise(0.0)
    now = stage.keep(now.select("*", least.alias("__least"), (F.col("tokens") / total).alias("w")), "rake-0")
    for k in range(1, rounds + 1):
        now = now.withColumn("__was", F.col("w"))
        for d, dim in enumerate(dims):
            have = now.groupBy(F.col(dim).alias("__value")).agg(F.sum("w").alias("__have"))
            factor = F.when(F.col("__have") > 0, F.col(f"__goal_{d}") / F.col("__have")).otherwise(0.0)
            scaled = F.least(F.greatest(F.col("w") * factor, F.col("__least")), F.col("tokens") / total / keep)
            now = stage.keep(now.join(have, F.col(dim).eqNullSafe(F.col("__value"))).withColumn("w", scaled).drop("__value", "__have"), f"rake-{k}-{d}")
        for d in range(len(dims) - 1):
            stage.drop(f"rake-{k}-{d}")
        if k > 1:
            stage.drop(f"rake-{k - 1}-{len(dims) - 1}")
        moved = now.agg(F.max(F.abs(F.col("w") - F.col("__was"))).alias("x")).first()["x"] or 0
        now = now.drop("__was")
        if moved <= CLOSE:
            break
    return now.select(*dims, "tokens", "w")


def calibrated(rows: DataFrame, names: list[str], targets: dict[str, dict] | None = None, limit: int = CELLS, keep: float = KEEP, stage: Stage | None = None) -> DataFrame:
    """(*names, tokens, w, p) of every cell of rows (*names, __weight): token sum, raked share of the output, and probability to stay."""
    stage = stage or Stage(rows.sparkSession, "mixing")
    cell = stage.keep(cells(rows, names, "__weight"), "cells")
    found = cell.limit(limit + 1).collect()
    total = cell.agg(F.sum("tokens").alias("t")).first()["t"] or 1.0
    given = targets or {}
    if len(found) > limit:
        goals = [goal_frames(cell, n, given.get(n), keep, stage) for n in names]
        weighed = rake_frames(cell, names, goals, stage, keep)
    else:
        found.sort(key=lambda r: tuple((r[n] is None, str(r[n])) for n in names))
        goals = []
        for n in names:
            shares: dict = {}
            for r in found:
                shares[r[n]] = shares.get(r[n], 0.0) + r["tokens"] / total
            goals.append(attainable(given[n] if n in given else flatten(shares), {v: x / keep for v, x in shares.items()}))
        w = rake([tuple(r[n] for n in names) for r in found], np.array([r["tokens"] for r in found], float), goals, keep)
        weighed = rows.sparkSession.createDataFrame([(*(r[n] for n in names), r["tokens"], float(x)) for r, x in zip(found, w, strict=True)], cell.select(*names, "tokens", F.lit(0.0).alias("w")).schema)
    return weighed.withColumn("p", F.least(F.lit(1.0), F.col("w") * F.lit(keep * total) / F.col("tokens")))


def draw(id_col: str, text_col: str, seed: int) -> Column:
    """A number in [0, 1) that follows from the row's id and text."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), whole_text(text_col)), 11).cast("double") / float(1 << 53)


def _facts(docs: DataFrame, dims: dict[str, Column], id_col: str, text_col: str, seed: int) -> DataFrame:
    return docs.select(F.col(id_col), *(x.alias(f"__{n}") for n, x in dims.items()), token_weight(whole_text(text_col)).alias("__weight"), draw(id_col, text_col, seed).alias("__draw"))


def _with_p(rows: DataFrame, on: list[Column], names: list[str], cell: DataFrame, limit: int) -> DataFrame:
    """Rows with __p of their cell; cells are broadcast below ``limit``."""
    renamed = cell.select(*(F.col(n).alias(f"__cell_{n}") for n in names), F.col("p").alias("__p"))
    if cell.limit(limit + 1).count() <= limit:
        renamed = F.broadcast(renamed)
    same = [x.eqNullSafe(F.col(f"__cell_{n}")) for n, x in zip(names, on, strict=True)]
    joined = rows.join(renamed, functools.reduce(lambda a, b: a & b, same), "left").drop(*(f"__cell_{n}" for n in names))
    return joined.withColumn("__p", F.coalesce("__p", F.lit(0.0)))


def decisions(docs: DataFrame, dims: dict[str, Column], targets: dict[str, dict] | None = None, id_col: str = "doc_id", text_col: str = "text", seed: int = 9, limit: int = CELLS, keep: float = KEEP) -> DataFrame:
    """(id, *dims, weight, probability, kept) of every row; texts are read once."""
    stage, names = Stage(docs.sparkSession, "mixing"), list(dims)
    facts = stage.keep(_facts(docs, dims, id_col, text_col, seed), "facts")
    cell = calibrated(facts.select(*(F.col(f"__{n}").alias(n) for n in names), "__weight"), names, targets, limit, keep, stage)
    rows = _with_p(facts, [F.col(f"__{n}") for n in names], names, cell, limit)
    return rows.select(id_col, *(F.col(f"__{n}").alias(n) for n in names), F.col("__weight").alias("weight"), F.col("__p").alias("probability"), (F.col("__draw") < F.col("__p")).alias("kept"))


def mixed(docs: DataFrame, dims: dict[str, Column], targets: dict[str, dict] | None = None, id_col: str = "doc_id", text_col: str = "text", seed: int = 9, limit: int = CELLS, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that stay; texts are read twice, and never shuffled."""
    names = list(dims)
    rows = docs.select(*(x.alias(n) for n, x in dims.items()), token_weight(whole_text(text_col)).alias("__weight"))
    cell = calibrated(rows, names, targets, limit, keep)
    named = docs.withColumns({f"__dim_{n}": x for n, x in dims.items()})  # a join's condition can't hold an Arrow function
    return _with_p(named, [F.col(f"__dim_{n}") for n in names], names, cell, limit).filter(draw(id_col, text_col, seed) < F.col("__p")).select(*docs.columns)
