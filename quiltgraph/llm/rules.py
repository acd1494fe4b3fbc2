"""Quality rules: a threshold table compiled into Spark projections, without user functions.

Each rule bounds a ratio of a text's counts. The counts are built-in functions over the text and its
arrays of words and lines, one row in and one row out, so nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the languages in the corpus, in lower case.
STOP_WORDS = tuple(
    "the of and to in is that it was for on are with by at from this be not or an as a"
    " der die das und in den von zu mit sich des auf für ist im dem nicht ein eine auch"
    " de la le et les des en un du une que est pour qui dans par sur pas plus avec"
    " el los que y se del las por con para una su al lo como no".split()
)


@dataclass(frozen=True)
class Rule:
    """``least <= ratio <= most``; ``ratio`` is SQL over the counts below, null (nothing to divide by) passes."""

    name: str
    ratio: str
    least: float | None = None
    most: float | None = None


#: The verdict of a text that does not fail the base rules. Bounds are wide of what prose has.
RULES = (
    Rule("word_length", "word_chars / n_words", 2.0, 14.0),
    Rule("symbols", "n_symbols / n_words", None, 0.3),
    Rule("exclamations", "n_exclamations / n_words", None, 0.5),
    Rule("stop_words", "n_stop_words / n_words", 0.02, None),
    Rule("duplicate_lines", "n_dup_lines / n_lines", None, 0.6),
    Rule("ellipsis_lines", "n_ellipsis_lines / n_lines", None, 0.5),
    Rule("bullet_lines", "n_bullet_lines / n_lines", None, 0.9),
)

#: A text with fewer words, or with more than this share of words in repeated windows, fails the base rules.
LEAST_WORDS, MOST_REPEATED = 50, 0.5
#: Distinct repeated windows up to which membership is a scan of them; above it positions are sorted. Same counts.
SCAN = 32


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean expression of all rules."""
    verdict = F.lit(True)
    for rule in rules:
        ratio = F.expr(f"try_divide(double({rule.ratio.split(' / ')[0]}), double({rule.ratio.split(' / ')[1]}))")
        for bound, holds in ((rule.least, ratio >= F.lit(rule.least)), (rule.most, ratio <= F.lit(rule.most))):
            if bound is not None:
                verdict = verdict & F.coalesce(holds, F.lit(True))
    return verdict


def removed(text: Column, characters: str) -> Column:
    """How many of ``characters`` the text holds."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts the rules divide (bigint); ``text`` is replaced by nothing, and null counts as empty.

    n_words, word_chars, n_symbols, n_exclamations, n_stop_words, n_lines (with a word), n_dup_lines
    (equal to an earlier one), n_ellipsis_lines, n_bullet_lines, n_repeat_words (words in a three-word
    window found twice or more, windows compared by a 64-bit hash).
    """
    kept = [c for c in docs.columns if c != text]
    whole = F.coalesce(F.col(text), F.lit("")).alias("__text")
    trimmed = F.btrim("__text", F.lit(BLANKS))
    split = docs.select(*kept, whole).select(*kept, "__text", trimmed.alias("__trimmed"))
    words = F.when(F.col("__trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("__trimmed", r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split("__text", "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    arrays = split.select(*kept, "__text", words.alias("__words"), lines.alias("__lines"))
    hashes = F.when(F.size("__words") >= 3, F.transform(F.sequence(F.lit(0), F.size("__words") - 3), lambda i: F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    counted = arrays.select(
        *kept,
        F.size("__words").cast("bigint").alias("n_words"),
        F.length(F.translate("__text", BLANKS, "")).cast("bigint").alias("word_chars"),
        removed(F.col("__text"), SYMBOLS).cast("bigint").alias("n_symbols"),
        removed(F.col("__text"), "!?").cast("bigint").alias("n_exclamations"),
        F.size(F.filter("__words", lambda w: F.lower(w).isin(*dict.fromkeys(STOP_WORDS)))).cast("bigint").alias("n_stop_words"),
        F.size("__lines").cast("bigint").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.filter("__lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("bigint").alias("n_ellipsis_lines"),
        F.size(F.filter("__lines", lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•", "·"))).cast("bigint").alias("n_bullet_lines"),
        hashes.alias("__windows"),
    )
    # nothing repeats where the windows are all distinct; else: the values found twice or more
    ordered = counted.withColumn("__sorted", F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), F.sort_array("__windows")))
    twice = F.array_distinct(F.filter("__sorted", lambda x, i: (i > 0) & (x == F.get("__sorted", i - 1))))
    found = ordered.withColumn("__twice", twice).drop("__sorted")
    positions = F.transform(F.filter(F.transform("__windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: F.array_contains("__twice", s["x"])), lambda s: s["i"])
    by_value = F.array_sort(F.transform("__windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    found = found.withColumn("__by_value", F.when(F.size("__twice") > SCAN, by_value))
    runs = F.filter("__by_value", lambda s, j: (F.get("__by_value", j - 1)["x"] == s["x"]) | (F.get("__by_value", j + 1)["x"] == s["x"]))
    positions = F.when(F.col("__twice").isNull(), F.lit(None)).when(F.size("__twice") > SCAN, F.sort_array(F.transform(runs, lambda s: s["i"]))).otherwise(positions)
    found = found.withColumn("__at", positions)
    covered = F.aggregate("__at", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last")), lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).cast("bigint").alias("n"), x.alias("last")), lambda a: a["n"])
    return found.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint"))).drop("__windows", "__twice", "__by_value", "__at")


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The counts of :func:`counts`, ``base_failed`` and ``kept`` for every row; columns but ``text`` stay.

    A null, empty or blank text has no words and fails the base rules. Texts are read whole; repeated rows
    get equal verdicts; an empty table gives an empty one. Columns named like a count are replaced.
    """
    names = {"n_words", "word_chars", "n_symbols", "n_exclamations", "n_stop_words", "n_lines", "n_dup_lines", "n_ellipsis_lines", "n_bullet_lines", "n_repeat_words", "base_failed", "kept"}
    counted = counts(docs.drop(*(c for c in docs.columns if c in names and c != text)), text)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MOST_REPEATED) * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compiled(rules))


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same verdicts over ``documents`` in DuckDB, windows compared as text."""
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    tests = " AND ".join(f"coalesce({rule.ratio.split(' / ')[0]}::DOUBLE / nullif({rule.ratio.split(' / ')[1]}, 0) {op} {bound}, true)" for rule in rules for op, bound in ((">=", rule.least), ("<=", rule.most)) if bound is not None)
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, concat_ws(' ', words[i], words[i + 1], words[i + 2]) AS g FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
c AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS n_exclamations,
  len(list_filter(words, lambda x: lower(x) IN ({stop}))) AS n_stop_words, len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  len(list_filter(lines, lambda x: suffix(rtrim(x), '...') OR suffix(rtrim(x), '…'))) AS n_ellipsis_lines, len(list_filter(lines, lambda x: substring(ltrim(x), 1, 1) IN ('-', '*', '•', '·'))) AS n_bullet_lines,
  coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov USING (rid)),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {int(100 * MOST_REPEATED)} * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {tests} AS kept FROM f"""
