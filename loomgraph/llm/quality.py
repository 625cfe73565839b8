"""Quality rules: a threshold table compiled into one Spark projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

# Frequent function words of the four languages the rules know.
STOP_WORDS = {
    "en": "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which".split(),
    "fr": "le la les de des du et en un une que qui dans pour par sur pas au est avec ce il sont aux ne se plus".split(),
    "de": "der die das und in zu den mit von für nicht ein eine im dem auf ist sich des als auch es an er so dass".split(),
    "es": "el la los las de que y en un una por con para se del no su al lo como es más pero sus le".split(),
}

#: (rule, metric, least, most): a document is kept if every metric lies within its bounds; None leaves a side open.
RULES = [
    ("mean_word_length", "mean_word_chars", 1.5, 15.0),
    ("symbols", "symbol_ratio", None, 0.10),
    ("stop_words", "stop_ratio", 0.02, None),
    ("duplicate_lines", "dup_line_ratio", None, 0.40),
    ("bullet_lines", "bullet_line_ratio", None, 0.90),
    ("ellipsis_lines", "ellipsis_line_ratio", None, 0.30),
    ("short_lines", "short_line_ratio", None, 0.67),
    ("open_lines", "end_line_ratio", 0.12, None),
]
#: Lines that a text must have for the shares of short and of ended ones to say something.
FEWEST_LINES = 5
#: Lines: what begins one of a list, how one ends that breaks off or that ends a sentence, and fewer characters than which are short.
BULLET, BROKEN_OFF, ENDED, SHORT = r"^[\x20\x09]*[-*\u2022\u2023\u25CF\u25E6]+[\x20\x09]", r"(\.\.\.|\u2026)[\x20\x09-\x0D]*$", r"[.!?\u2026\u3002]['\"\u201D\u2019)]*[\x20\x09-\x0D]*$", 30

WINDOW = 8


def _let(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use`` as a bound variable; a column would be evaluated at each mention."""
    return F.get(F.transform(F.array(value), use), 0)


def _windows(words: Column) -> Column:
    """Hashes of all runs of eight words, by position: of single words, then of pairs of runs of 1, 2 and 4."""

    def doubled(runs: Column, n: int) -> Column:
        return F.transform(runs, lambda h, i: F.xxhash64(h, F.get(runs, i + n)))

    hashes = _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _let(doubled(h, 1), lambda h: _let(doubled(h, 2), lambda h: doubled(h, 4))))
    return F.slice(hashes, F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))


def _union(starts: Column) -> Column:
    """Words that windows from these places cover together."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
    covered = F.aggregate(starts, zero, lambda a, i: F.struct((i + WINDOW).alias("end"), (a["total"] + i + WINDOW - F.greatest(i, a["end"])).alias("total")))
    return covered["total"]


def _repeated(hashes: Column) -> Column:
    """Words that lie in a window found at least twice: sort windows, keep those equal to a neighbour, join their spans."""
    ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(r: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(r, k + 1)["h"] == x["h"], F.lit(False)) | F.coalesce((k > 0) & (F.get(r, k - 1)["h"] == x["h"]), F.lit(False))
        return F.sort_array(F.transform(F.filter(r, same), lambda x: x["i"]))

    return _let(ranked, lambda r: _let(twice(r), _union))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts the rules need; one projection over each row, no shuffle and no user functions.

    Null text counts as empty. Lines are those with a word. Adds ``n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words, n_stop``, and the numbers of lines that begin as a list does, break off, are short, or end a
    sentence (``n_bullet_lines, n_ellipsis_lines, n_short_lines, n_end_lines``); columns of these names are replaced.
    """
    stop = sorted({w for words in STOP_WORDS.values() for w in words})
    whole = F.coalesce(F.col(text), F.lit(""))
    length = lambda pattern: F.length(F.regexp_replace(whole, pattern, "")).cast("long")

    def of_words(words: Column) -> Column:
        # Most texts repeat no window; the costlier count is evaluated for the others alone.
        repeats = _let(_windows(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_repeated(h)))
        stops = F.size(F.filter(words, lambda w: F.lower(w).isin(stop)))
        return F.struct(F.size(words).alias("n_words"), repeats.alias("n_repeat_words"), stops.alias("n_stop"))

    like = lambda lines, test: F.size(F.filter(lines, test))

    def of_lines(lines: Column) -> Column:
        short = like(lines, lambda x: F.length(F.btrim(x, F.lit(" \t\r\x0b\x0c"))) < SHORT)
        kinds = {"n_bullet_lines": like(lines, lambda x: x.rlike(BULLET)), "n_ellipsis_lines": like(lines, lambda x: x.rlike(BROKEN_OFF)), "n_short_lines": short, "n_end_lines": like(lines, lambda x: x.rlike(ENDED))}
        return F.struct(F.size(lines).alias("n_lines"), F.size(F.array_distinct(lines)).alias("n_distinct"), *[v.alias(k) for k, v in kinds.items()])

    counted = docs.withColumns(
        {
            "_w": _let(F.array_remove(F.split(whole, r"[\x20\x09-\x0D]+"), ""), of_words),
            "_l": _let(F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD)), of_lines),
            "word_chars": length(r"[\x20\x09-\x0D]+"),
            "n_symbols": length(r"[^#*$%&|<>]+"),
        }
    )
    parts = {c: F.col(f"_w.{c}").cast("long") for c in ("n_words", "n_repeat_words", "n_stop")}
    parts |= {c: F.col(f"_l.{c}").cast("long") for c in ("n_bullet_lines", "n_ellipsis_lines", "n_short_lines", "n_end_lines")}
    parts |= {"n_lines": F.col("_l.n_lines").cast("long"), "n_dup_lines": (F.col("_l.n_lines") - F.col("_l.n_distinct")).cast("long")}
    return counted.withColumns(parts).drop("_w", "_l")


#: A metric that has nothing to divide by is null.
METRICS = {
    "mean_word_chars": lambda: F.try_divide(F.col("word_chars"), F.col("n_words")),
    "symbol_ratio": lambda: F.try_divide(F.col("n_symbols"), F.col("n_words")),
    "stop_ratio": lambda: F.try_divide(F.col("n_stop"), F.col("n_words")),
    "dup_line_ratio": lambda: F.try_divide(F.col("n_dup_lines"), F.col("n_lines")),
    "bullet_line_ratio": lambda: F.try_divide(F.col("n_bullet_lines"), F.col("n_lines")),
    "ellipsis_line_ratio": lambda: F.try_divide(F.col("n_ellipsis_lines"), F.col("n_lines")),
    "short_line_ratio": lambda: F.when(F.col("n_lines") >= FEWEST_LINES, F.col("n_short_lines") / F.col("n_lines")),
    "end_line_ratio": lambda: F.when(F.col("n_lines") >= FEWEST_LINES, F.col("n_end_lines") / F.col("n_lines")),
}


def compile_rules(rules: list[tuple]) -> Column:
    """The names of the rules that a row breaks, as an array; a metric that is null (nothing to divide by) breaks none."""

    def broken(rule: str, metric: str, least: float | None, most: float | None) -> Column:
        value = METRICS[metric]()
        sides = [value < least] if least is not None else []
        sides += [value > most] if most is not None else []
        return F.when(reduce(lambda a, b: a | b, sides), F.lit(rule))

    return F.array_compact(F.array(*[broken(*rule) for rule in rules]))


def quality_rules(docs: DataFrame, text: str = "text", rules: list[tuple] | None = None, fewest_words: int = 20, repeat_percent: int = 30) -> DataFrame:
    """Add counts, ``base_failed``, ``broken`` (names of broken rules) and ``kept`` to every row.

    Empty or null texts have no words, fail the base and are not kept. Repeated rows are judged alike, one by one.
    Other columns pass through; those with the names added here are replaced.
    """
    judged = measure(docs, text).withColumn("broken", compile_rules(RULES if rules is None else rules))
    failed = (F.col("n_words") < fewest_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
