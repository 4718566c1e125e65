"""Quality rules: a threshold table compiled into one projection of Spark expressions.

``evaluate`` is a single struct expression of the text (no user functions, no shuffle): every
measure, the failed rules and the verdict. Intermediate arrays are bound once as lambda
variables, so a filter on the verdict does not evaluate them again.

Repeated words: the 8-word windows of a text are hashed from word hashes; only if some window
hash occurs twice, the (hash, position) pairs are sorted and the places of equal neighbours are
folded into a covered length. This takes n log n steps for a text of n words, however repetitive.

Cases: null text counts as empty; empty texts have no words and fail the base rule; other
columns, whatever their names, pass through untouched; repeated rows are judged alike; a text of any length is
judged whole; an empty table gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE_RUN = r"[\x20\x09-\x0D]+"
REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# Fixed list: frequent function words of the corpus languages (en, fr, de, es).
STOP_WORDS = ("the and of to in is that with for was on are as be by this it or from at an "
              "le la les de des du et en un une que est pour dans qui "
              "der die das und ist ein eine nicht mit von zu den im auf für "
              "el los las y no se por para con del").split()


class Rule(NamedTuple):
    """Fails when 100 * part is above / below percent * whole, if the guard holds."""

    name: str
    part: str
    sign: str
    percent: int
    whole: str
    guard: str = "n_words"
    at_least: int = 1


RULES = (
    Rule("symbols", "n_symbols", ">", 3, "word_chars"),
    Rule("marks", "n_marks", ">", 5, "word_chars"),
    Rule("long_words", "word_chars", ">", 2500, "n_words"),
    Rule("stop_words", "n_stop_words", "<", 5, "n_words", "n_words", 50),
    Rule("duplicate_lines", "n_dup_lines", ">", 50, "n_lines", "n_lines", 5),
)


def let(value: Column, fn) -> Column:
    """``fn(value)`` with the value evaluated once."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda x: x != "")


def _covered(starts: Column, width: int) -> Column:
    """Length covered by [s, s + width) over ascending starts."""
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("reach"))
    return F.aggregate(starts, zero, lambda a, s: F.struct(
        (a["sum"] + s + width - F.greatest(s, a["reach"])).alias("sum"), (s + width).alias("reach")), lambda a: a["sum"])


def repeat_words(w: Column, width: int = REPEAT_WINDOW) -> Column:
    """Words in windows of ``width`` words found twice or more among ``w``, the first included."""
    def places(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["at"]))

    def of_hashes(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - width),
                              lambda i: F.struct(F.xxhash64(F.slice(h, i + 1, F.lit(width))).alias("h"), i.cast("long").alias("at")))
        return let(windows, lambda p: F.when(F.size(F.array_distinct(F.transform(p, lambda x: x["h"]))) == F.size(p), F.lit(0).cast("long"))
                   .otherwise(let(F.sort_array(p), lambda s: _covered(places(s), width))))

    return F.when(F.size(w) < width + 1, F.lit(0).cast("long")).otherwise(let(F.transform(w, lambda x: F.xxhash64(x)), of_hashes))


def evaluate(text: Column, rules: tuple[Rule, ...] = RULES, min_words: int = MIN_WORDS,
             max_repeat_percent: int = MAX_REPEAT_PERCENT, stop_words=STOP_WORDS) -> Column:
    """struct(measures ..., base_failed, failed_rules array, kept) of a text."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def measure(w: Column, v: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            F.length(F.regexp_replace(t, r"[^!?]+", "")).cast("long").alias("n_marks"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*stop_words))).cast("long").alias("n_stop_words"),
            F.size(v).cast("long").alias("n_lines"),
            (F.size(v) - F.size(F.array_distinct(v))).cast("long").alias("n_dup_lines"),
            repeat_words(w).alias("n_repeat_words"))

    def judge(m: Column) -> Column:
        base = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > max_repeat_percent * m["n_words"])
        failed = []
        for r in rules:
            part, whole = 100 * m[r.part], r.percent * m[r.whole]
            bad = (m[r.guard] >= r.at_least) & (part > whole if r.sign == ">" else part < whole)
            failed.append(F.when(bad, F.lit(r.name)))
        names = F.array_compact(F.array(*failed))
        measures = [m[c].alias(c) for c in MEASURES]
        return let(names, lambda f: F.struct(*measures, base.alias("base_failed"), f.alias("failed_rules"), (~base & (F.size(f) == 0)).alias("kept")))

    return let(words(t), lambda w: let(lines, lambda v: let(measure(w, v), judge)))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_marks", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words")


def quality_report(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), **kw) -> DataFrame:
    """One row per document: the ``keep`` columns and the fields of ``evaluate``."""
    return docs.select(*keep, evaluate(F.col("text"), **kw).alias("_q")).select(*keep, "_q.*")


def quality_filter(docs: DataFrame, **kw) -> DataFrame:
    """The documents that pass, with all their columns."""
    return docs.where(evaluate(F.col("text"), **kw)["kept"])
