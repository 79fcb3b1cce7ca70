"""Text primitives and metrics as column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: characters that count as garbled, and marks of unresolved glyphs
GARBLED = r"[\x{FFFD}\x{E000}-\x{F8FF}\x00-\x08\x0B\x0C\x0E-\x1F]"
CID = r"\(cid:\d+\)"
CID_LOOSE = r"(?i)\(cid:\d+\)|cid:\d+"
#: white space as text editors see it: Unicode's and the four separators
SPACE = r"\s\x1C-\x1F"
TOKEN = rf"(?U)[^{SPACE}]+"
ENGLISH = r"[A-Za-z][A-Za-z'\-]{1,}"
EDGE = ".,!?;:\"'"
LATEX_COMMAND = r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?(?:\{[^{}]*\})?"
CITATION = r"\[[0-9,\s-]{1,20}\]|\([A-Z][A-Za-z]+,\s+\d{4}\)"
FORMULA = r"(?i)[=<>+\-*/]|sum|sqrt|log"


def strip(x: Column) -> Column:
    """White space off both ends, line ends and Unicode spaces too."""
    return F.regexp_replace(x, rf"(?U)^[{SPACE}]+|[{SPACE}]+$", "")


def count(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit(pattern))


def occurrences(x: Column, part: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(x) - F.length(F.replace(x, F.lit(part), F.lit("")))) / len(part)).cast("int")


def ratio(a: Column, b: Column, empty: float) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(empty))


def token_estimate(x: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(x) / 4).cast("int"))


def word_count(x: Column) -> Column:
    return count(x, TOKEN)


def english_word_ratio(x: Column) -> Column:
    return ratio(count(x, ENGLISH), word_count(x), 0.0)


def garbled_ratio(x: Column) -> Column:
    return ratio(count(x, GARBLED), F.length(x), 1.0)


def printable_ratio(x: Column) -> Column:
    return ratio(F.length(x) - count(x, r"[[\p{C}\p{Z}]&&[^ \n\r\t]]"), F.length(x), 0.0)


def words(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0))


def mean_word_length(x: Column) -> Column:
    """Mean length of words without punctuation at their ends."""
    edge = "[" + EDGE.replace('"', '\\"') + "]"
    total = F.aggregate(words(x), F.lit(0), lambda a, w: a + F.length(F.regexp_replace(w, f"^{edge}+|{edge}+$", "")))
    return ratio(total, word_count(x), 0.0)


def cid_severity(n: Column) -> Column:
    return F.when(n == 0, "none").when(n <= 3, "minor").when(n <= 10, "moderate").otherwise("critical")


def cid_ratio(x: Column) -> Column:
    return count(x, CID) / F.greatest(F.lit(1), word_count(x))


def cid_cleaned(x: Column) -> Column:
    return F.regexp_replace(x, CID, "[UNKNOWN_CHAR]")


def can_translate(x: Column) -> Column:
    return (cid_severity(count(x, CID)) != "critical") & (garbled_ratio(x) < 0.1) & (printable_ratio(x) > 0.8)


def quality(x: Column) -> Column:
    """The text quality record."""
    n = count(x, CID)
    return F.struct(n.alias("cid_count"), cid_severity(n).alias("severity"), garbled_ratio(x).alias("garbled_ratio"), printable_ratio(x).alias("printable_ratio"), mean_word_length(x).alias("avg_word_length"), can_translate(x).alias("can_translate"))


def normal_line(x: Column) -> Column:
    one = F.regexp_replace(strip(x), r"(?U)\s+", " ")
    return F.lower(F.regexp_replace(F.regexp_replace(one, r"(?i)\bpage\s+\d+\b", "page #"), r"^\d+$", "#"))


def normal_pattern(x: Column) -> Column:
    one = F.regexp_replace(strip(x), r"(?U)\s+", " ")
    one = F.regexp_replace(F.regexp_replace(one, r"(?i)\bpage\s+\d+\b", "PAGE_NUM"), r"^\d+$", "NUM_ONLY")
    return F.lower(F.regexp_replace(one, r"(?i)\b\d{1,3}\s*of\s*\d{1,3}\b", "PAGE_RANGE"))


def academic_marks(x: Column) -> Column:
    return F.struct(x.rlike(r"(?i)\babstract\b").alias("has_abstract"), x.rlike(r"(?i)\breferences\b").alias("has_references"), (count(x, FORMULA) > 8).alias("has_formulas"), x.rlike(CITATION).alias("has_citations"))


def length_similarity(a: Column, b: Column) -> Column:
    return ratio(F.least(a, b), F.greatest(a, b), 0.0)


def has_letter(x: Column) -> Column:
    return x.rlike(r"\p{L}")


def latex_translatable(x: Column) -> Column:
    bare = strip(x)
    return (F.length(bare) >= 2) & F.regexp_replace(bare, LATEX_COMMAND, " ").rlike(r"[A-Za-z\u00C0-\uFFFF]")


def latex_command_only(x: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(strip(x), LATEX_COMMAND, ""), r"[{}\\\s,.;:!?~&%$#_^*-]+", "")
    return plain == ""


def looks_like_code(x: Column) -> Column:
    has = lambda *parts: [F.contains(x, F.lit(p)) for p in parts]
    any_ = lambda xs: F.greatest(*xs) if len(xs) > 1 else xs[0]
    assigned = occurrences(x, "=")
    rules = [
        any_(has("{")) & any_(has("}")) & (assigned >= 1),
        any_(has("[")) & any_(has("]")) & (assigned >= 1),
        (occurrences(x, ";") >= 2) & (assigned >= 1) & any_(has("(", ")")),
        (assigned >= 2) & any_(has('("', '")', ",'", "')")),
        any_(has(":")) & any_(has("(")) & any_(has(")")) & ~any_(has("{", "}")),
    ]
    return (F.length(x) >= 10) & any_(rules)


def code_language(x: Column) -> Column:
    has = lambda p: F.contains(x, F.lit(p))
    python, script = has("def ") | has("import ") | has("class "), has("function ") | has("const ") | has("let ")
    return F.when(python, "python").when(script, "javascript").when(has("{") & has("}") & has(";"), "c").otherwise("python")


def lines(x: Column) -> Column:
    """Lines without their ends; a last empty line is none."""
    parts = F.split(F.regexp_replace(x, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]", "\n"), "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def unwrapped(x: Column) -> Column:
    """Markdown marks off each line; empty lines go."""
    bare = F.transform(lines(x), lambda s: F.regexp_replace(F.regexp_replace(s, r"^\s{0,3}#{1,6}\s+", ""), r"^\s*[-*]\s+", ""))
    bare = F.transform(bare, lambda s: strip(F.regexp_replace(s, r"\*\*|__", "")))
    return F.array_join(F.filter(bare, lambda s: s != ""), "\n")


def heading_number(x: Column) -> Column:
    """(number or null, title) of a heading's text."""
    pattern = r"(?i)^(Chapter\s+\d+(?:\.\d+)*\.?|\d+(?:\.\d+)*\.?)\s+(.+)$"
    hit = x.rlike(pattern)
    return F.struct(F.when(hit, F.regexp_extract(x, pattern, 1)).alias("number"), F.when(hit, F.regexp_extract(x, pattern, 2)).otherwise(x).alias("title"))


def table_shape(x: Column) -> Column:
    """Cells of each table line that is no separator."""
    rows = F.filter(F.transform(lines(x), strip), lambda s: F.contains(s, F.lit("|")) & ~s.rlike(r"^\|?\s*:?-{3,}:?"))
    return F.transform(rows, lambda s: F.size(F.split(F.regexp_replace(s, r"^\|+|\|+$", ""), r"\|", -1)))


def code_fences(text: str) -> str:
    """Fences around runs of code-like lines; blank lines, comments and docstring quotes go on with a run."""
    import re

    rows, mark = text.split("\n"), re.compile("|".join(CODE_LINES))
    kinds = "".join("c" if mark.match(s) else "g" if not s.strip() or s.strip().startswith(GOES_ON) else "-" for s in rows)
    out, at = [], 0
    for run in re.finditer("c[cg]*", kinds):
        first, end = run.span()
        code = "\n".join(rows[first:end])
        named = (name for name, words in LANGUAGE_WORDS if any(w in code for w in words))
        language = next(named, "c" if all(x in code for x in "{};") else "python")
        out += rows[at:first]
        if not first or rows[first - 1].strip() != "```":
            out.append(f"```{language}")
        out += rows[first:end]
        if end < len(rows) and rows[end].strip() != "```":
            out.append("```")
        at = end
    return "\n".join(out + rows[at:])


#: fixed values: what goes on with code, and the words that name its language
GOES_ON = ('"""', "'''", "#")
LANGUAGE_WORDS = (("python", ("def ", "import ", "class ")), ("javascript", ("function ", "const ", "let ")))
#: fixed values: beginnings of lines that look like code
CODE_LINES = (
    r"^\s*(async\s+)?def\s+\w+\s*\(",
    r"^\s*class\s+\w+.*:",
    r"^\s*import\s+\w+",
    r"^\s*from\s+\w+\s+import",
    r"^\s*\w+\s*=\s*\w+\(",
    r"^\s*await\s+\w+",
    r"^\s*if\s+__name__\s*==\s*[\"']__main__[\"']",
)
