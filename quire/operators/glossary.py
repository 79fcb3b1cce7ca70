"""Glossary matches, prompts, and the text transformation that stands in for a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A glossary is broadcast only below so many terms; above, the join is left to Spark.
TERMS = 100_000
#: fixed value: what the prompt's text follows
TEXT_MARK = "Text to translate:"


def contains_term(text: Column, term: Column, case_sensitive: Column) -> Column:
    """G1: whether a text holds a term, by case or not."""
    return F.when(case_sensitive, F.contains(text, term)).otherwise(F.contains(F.lower(text), F.lower(term)))


def term_matches(chunks: DataFrame, terms: DataFrame, text: str = "source_text") -> DataFrame:
    """G1: (chunk, term) pairs; a nested loop by nature, with the glossary as its small side."""
    small = F.broadcast(terms) if terms.limit(TERMS + 1).count() <= TERMS else terms
    return chunks.join(small, contains_term(F.col(text), F.col("source_term"), F.col("case_sensitive")))


def sorted_terms(terms: Column) -> Column:
    """Terms of an array of (priority, source_term, target_term): priority falling, then name."""
    order = F.array_sort(F.transform(terms, lambda t: F.struct((-t["priority"]).alias("rank"), t["source_term"].alias("source_term"), t["target_term"].alias("target_term"))))
    return F.transform(order, lambda t: F.struct(t["source_term"].alias("source_term"), t["target_term"].alias("target_term")))


#: Rules that a format adds to the prompt.
RULES = {"html": "Keep every marker line as it is.", "latex": "Keep commands and every marker line as they are.", "srt": "Keep every marker line; cues stay short.", "vtt": "Keep every marker line; cues stay short.", "ipynb": "Keep Markdown structure.", "epub": "Keep inline marks.", "docx": "Keep paragraph breaks.", "pdf": "Keep line breaks where sense allows."}
LABELS = {"epub": "File", "ipynb": "Cell under", "docx": "Section", "pdf": "Page"}


def chapter_label(fmt: Column, chapter: Column) -> Column:
    """How the chapter is named for a format."""
    label = F.coalesce(*(F.when(fmt == k, F.lit(v)) for k, v in LABELS.items()), F.lit("Chapter"))
    return F.when(chapter.isNotNull(), F.concat_ws(": ", label, chapter.cast("string")))


def prompt(fmt: Column, text: Column, terms: Column, language: Column, chapter: Column) -> Column:
    """(system, user) of a chunk; terms: ordered (source_term, target_term)."""
    rule = F.coalesce(*(F.when(fmt == k, F.lit(v)) for k, v in RULES.items()), F.lit("Keep Markdown structure."))
    system = F.concat_ws("\n", F.concat(F.lit("You translate documents into "), language, F.lit(".")), F.lit("Keep every placeholder of the form __LT_..._000000__ exactly."), rule)
    lines = F.array_join(F.transform(terms, lambda t: F.concat(F.lit("- "), t["source_term"], F.lit(" => "), t["target_term"])), "\n")
    glossary = F.when(F.size(terms) > 0, F.concat(F.lit("Glossary:\n"), lines))
    user = F.concat_ws("\n\n", chapter_label(fmt, chapter), glossary, F.concat(F.lit(TEXT_MARK + "\n"), text))
    return F.struct(system.alias("system"), user.alias("user"))


def prompt_text(user: Column) -> Column:
    """The text of a prompt: what follows the mark, stripped."""
    at = F.instr(user, TEXT_MARK)
    body = F.when(at > 0, user.substr(at + len(TEXT_MARK), F.length(user))).otherwise(user)
    return F.regexp_replace(body, r"(?U)^\s+|\s+$", "")


def replaced(text: Column, terms: Column) -> Column:
    """Each term as a whole word gives way to its target, in the terms' order."""
    quote = lambda s: F.concat(F.lit(r"\b\Q"), s, F.lit(r"\E\b"))
    plain = lambda s: F.regexp_replace(s, r"([\\$])", r"\\$1")
    return F.aggregate(terms, text.cast("string"), lambda acc, t: F.regexp_replace(acc, quote(t["source_term"]), plain(t["target_term"])).cast("string"))


def provided(chunks: DataFrame, provider: Callable[[str, str], str], user: str = "user", system: str = "system") -> DataFrame:
    """``chunks`` with target_text and error_message by a provider called as provider(system, user).

    Arrow batches; an exception is one row's error, not the task's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for a, b in zip(batch.column(batch.schema.get_field_index(system)), batch.column(batch.schema.get_field_index(user)), strict=True):
                try:
                    texts.append(provider(a.as_py(), b.as_py()))
                    errors.append(None)
                except Exception as error:  # the provider's own
                    texts.append(None)
                    errors.append(str(error))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=[*batch.schema.names, "target_text", "error_message"])

    schema = T.StructType([*chunks.schema.fields, T.StructField("target_text", T.StringType()), T.StructField("error_message", T.StringType())])
    return chunks.mapInArrow(run, schema)


def attempts_left(retry_count: Column, most: int = 3) -> Column:
    """How many attempts a chunk still has: from its count to the limit, both included."""
    return F.greatest(F.lit(0), F.lit(most) - retry_count + 1)


def status_after(valid: Column, retry_count: Column, batch: bool = False, failed: Column | None = None, most: int = 3) -> Column:
    """A chunk's state after an attempt, alone or in a batch."""
    bad = F.lit("NEED_REVIEW") if batch else F.when(retry_count >= most, "FAILED").otherwise("PENDING")
    out = F.when(valid, "DONE").otherwise(bad)
    return out if failed is None else F.when(failed, "FAILED").otherwise(out)
