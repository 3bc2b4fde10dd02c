"""Quality rules: a table of thresholds compiled into one projection.

Measures are built-in expressions over a text's words (runs of anything but ASCII
white space) and lines. ``RULES`` names a ratio of two measures, and the range in
which it must lie; ``compiled`` turns the table into one column of failed rules.
No user functions, joins or shuffles.

Repeated words are those covered by windows of ``WINDOW`` words that occur twice or
more in the text. If some window does, the windows are sorted with their positions and equal
neighbours give the covered words, so long texts cost n log n.

Defined results: null and empty texts have no words and fail; a ratio whose
divisor is zero counts as zero; repeated rows and extra columns make no difference.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import WORD

WINDOW = 3
SYMBOLS = "[#*$%&|<>]"
# Very frequent words of English, German, French and Spanish.
STOP_WORDS = tuple(
    (
        "the of and to in a is that it for on was be as with by this are from or an at "
        "der die das und zu den mit von ist auf ein eine nicht im "
        "le la les de des et en un une du que qui est dans pour "
        "el los las y se por con para del no su al"
    ).split()
)


@dataclass(frozen=True)
class Rule:
    """``least`` <= ``measure`` / ``per`` <= ``most``; an open end is None."""

    name: str
    measure: str
    per: str | None = None
    least: float | None = None
    most: float | None = None


BASE_RULES = (
    Rule("few_words", "n_words", least=50),
    Rule("repeated_words", "n_repeat_words", "n_words", most=0.5),
)
RULES = (
    Rule("word_length", "word_chars", "n_words", least=2, most=12),
    Rule("symbols", "n_symbols", "n_words", most=0.1),
    Rule("stop_words", "n_stop_words", least=2),
    Rule("no_letters", "n_letter_words", "n_words", least=0.7),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=0.5),
    Rule("bullets", "n_bullet_lines", "n_lines", most=0.9),
    Rule("cut_lines", "n_cut_lines", "n_lines", most=0.3),
)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and the measures, as longs. A measure replaces a column of its name."""
    held = docs.select(F.struct(*docs.columns).alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    held = held.withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD))
    held = held.withColumns({"_lines": lines, "_windows": _windows(F.col("_words"))})
    words, lines = F.col("_words"), F.col("_lines")
    found = {
        "n_words": F.size(words),
        "word_chars": F.char_length(F.array_join(words, "")),
        "n_symbols": F.regexp_count("_text", F.lit(SYMBOLS)),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _covered(F.col("_windows")),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))),
        "n_letter_words": F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[-*•]"))),
        "n_cut_lines": F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)\s*$"))),
    }
    own = [F.col("_doc")[c].alias(c) for c in docs.columns if c not in found]
    return held.select(*own, *[v.cast("long").alias(k) for k, v in found.items()])


def _windows(words: Column) -> Column:
    """The words of every window, joined."""
    at = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    window = F.transform(at, lambda i: F.concat_ws(" ", *[F.element_at(words, i + k) for k in range(WINDOW)]))
    return F.when(F.size(words) >= WINDOW, window).otherwise(F.array().cast("array<string>"))


def _covered(windows: Column) -> Column:
    placed = F.sort_array(F.arrays_zip(windows.alias("w"), F.sequence(F.lit(1), F.size(windows)).alias("i")))
    twice = F.zip_with(
        placed,
        F.slice(placed, 2, F.size(windows)),
        lambda a, b: F.when(a["w"] == b["w"], F.array(*[x["i"] + k for x in (a, b) for k in range(WINDOW)])),
    )
    covered = F.size(F.array_distinct(F.flatten(F.filter(twice, lambda x: x.isNotNull()))))
    # Most texts repeat no window; they need no sort.
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(covered)


def compiled(rules: tuple[Rule, ...]) -> Column:
    """The names of the rules that a row of measures fails."""
    return F.array_compact(F.array(*[F.when(_fails(r), F.lit(r.name)) for r in rules]))


def _fails(rule: Rule) -> Column:
    # Multiplied out, so that there is no division and whole numbers stay exact.
    value, per = F.col(rule.measure), F.col(rule.per) if rule.per else F.lit(1)
    tests = []
    if rule.least is not None:
        tests.append(value < rule.least * per)
    if rule.most is not None:
        tests.append(value > rule.most * per)
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def judged(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with measures, ``base_failed``, ``failed`` (rule names) and ``kept``."""
    base = F.size(compiled(BASE_RULES)) > 0
    out = measures(docs, text).withColumns({"base_failed": base, "failed": compiled(RULES)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
