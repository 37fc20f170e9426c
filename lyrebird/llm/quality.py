"""Quality rules: one threshold table, compiled into Spark expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyrebird.llm.shared import SPACE

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a and are as at be by for from in is it of on or that the this to was with "
    "au avec dans de des du en est et la le les par pas pour que qui sur un une "
    "als auf das dem den der die ein eine für im ist mit nicht sich und von zu "
    "al con del el es lo los las no para por se su y"
).split()
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A document fails when its measure lies outside [least, most]."""

    measure: str
    least: float | None = None
    most: float | None = None


#: Base rules, then the method's own; ratios are per word, dup_line_ratio per line that holds a word.
RULES = (
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbol_ratio", None, 0.1),
    Rule("stop_word_ratio", 0.06, None),
    Rule("dup_line_ratio", None, 0.5),
)


def _measures(docs: DataFrame, text: str) -> DataFrame:
    """Counts of each text. The arrays are columns of their own, so that lambdas read them and don't build them again."""
    body = F.coalesce(F.col(text), F.lit(""))
    w, n, g = F.col("__quality_words"), F.size("__quality_words"), F.col("__quality_hashes")
    words = docs.withColumns({
        "__quality_words": F.array_remove(F.split(body, f"[{SPACE}]+"), ""),
        "__quality_lines": F.filter(F.split(body, "\n"), lambda x: x.rlike(f"[^{SPACE}]")),
        "n_symbols": (F.char_length(body) - F.char_length(F.translate(body, SYMBOLS, ""))).cast("long"),
        "word_chars": F.char_length(F.translate(body, " \t\n\x0b\x0c\r", "")).cast("long"),
    })
    at = lambda i, k: F.get(w, i + k)
    hashed = words.withColumns({
        "n_words": n.cast("long"),
        "n_lines": F.size("__quality_lines").cast("long"),
        "n_dup_lines": (F.size("__quality_lines") - F.size(F.array_distinct("__quality_lines"))).cast("long"),
        "n_stop_words": F.size(F.filter(w, lambda x: F.lower(F.rtrim(x, F.lit(".,"))).isin(STOP_WORDS))).cast("long"),
        "__quality_hashes": F.when(n >= WINDOW, F.transform(F.slice(w, 1, n - (WINDOW - 1)), lambda x, i: F.xxhash64(x, *(at(i, k) for k in range(1, WINDOW))))),
    })
    # Equal windows have equal hashes, so only where two hashes meet are the windows themselves sorted and compared.
    met = F.size(F.array_distinct(g)) < F.size(g)
    key = lambda i: F.concat_ws(" ", F.slice(w, i + 1, WINDOW))
    in_order = hashed.withColumn("__quality_windows", F.when(met, F.sort_array(F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.struct(key(i).alias("k"), i.alias("i"))))))
    s = F.col("__quality_windows")
    same = lambda x, j: F.get(s, j)["k"] == x["k"]
    twice = F.filter(s, lambda x, j: F.coalesce(F.when(j > 0, same(x, j - 1)), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False)))
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    start = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).alias("n"))
    covered = F.aggregate(starts, start, lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(WINDOW), i - a["at"])).alias("n")), lambda a: a["n"])
    return in_order.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__quality_words", "__quality_hashes", "__quality_windows", "__quality_lines")


def _passes(rule: Rule) -> Column:
    x = F.col(rule.measure)
    ok = F.lit(True)
    if rule.least is not None:
        ok = ok & (x >= rule.least)
    if rule.most is not None:
        ok = ok & (x <= rule.most)
    return ok


def quality_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of docs, with its counts, ratios, failed_rules (names), base_failed and kept.

    The base rule fails texts of under 10 words, and those with over a fifth of their words in 5-word windows that
    the text repeats. The rest is the table, compiled into one projection without user functions or a shuffle.
    A null or empty text has no words, so it fails the base rule; ratios of such a text are 0. Rows are judged one by
    one: ties and repeated rows get equal verdicts. Columns of docs with the name of a result are replaced.
    """
    per = lambda n, d: F.when(F.col(d) > 0, F.col(n) / F.col(d)).otherwise(F.lit(0.0))
    out = _measures(docs, text).withColumns({
        "mean_word_chars": per("word_chars", "n_words"),
        "symbol_ratio": per("n_symbols", "n_words"),
        "stop_word_ratio": per("n_stop_words", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    })
    failed = F.filter(F.array(*(F.when(~_passes(r), F.lit(r.measure)) for r in rules)), lambda x: x.isNotNull())
    return out.withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that quality_rules keeps, with their own columns.

    A generator takes the place of a filter, which Spark would push below the columns that its condition is made of,
    and so work these out again for each element of the arrays they hold.
    """
    once = F.when(F.col("kept"), F.array(F.lit(True)))  # null: no row
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__quality_row"), F.col(text).alias("text"))
    return quality_rules(packed, "text", rules).select("__quality_row", F.explode(once)).select("__quality_row.*")
