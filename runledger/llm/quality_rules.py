"""Quality rules as a short-circuit cascade of column expressions.

The cost and the rejection rate of every rule are estimated on a bounded sample; the rules
then run in order of rejections per second as one CASE expression, so a text that an early
rule rejects is not looked at by the later ones. The order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, aside, table

WINDOW = 5
LEAST_WORDS = 10
SAMPLE_ROWS = 200
SAMPLE_ROUNDS = 10


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that no later step recomputes: filters do not move below a generator."""
    made = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select("*", F.inline(made))


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """How many words lie in a window of ``size`` words that occurs twice or more in the array."""

    def at_repeats(pairs: Column) -> Column:
        same = lambda s, j: F.when(
            (s["h"] == F.get(pairs, j - 1)["h"]).eqNullSafe(True) | (s["h"] == F.get(pairs, j + 1)["h"]).eqNullSafe(True), s["i"])
        return F.sort_array(F.filter(F.transform(pairs, same), lambda i: i.isNotNull()))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda acc, i: F.struct((i + size).alias("end"), (acc["n"] + i + size - F.greatest(i, acc["end"])).alias("n"))
        return F.aggregate(places, start, step, lambda acc: acc["n"])

    def counted(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(let(pairs, at_repeats), covered))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    return F.when(F.size(words) < size, 0).otherwise(let(hashes, counted)).cast("long")


def with_measures(docs: DataFrame) -> DataFrame:
    """Adds words and lines (those with a word) of the text; a null text has none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return once(
        docs,
        q_text=text,
        q_words=F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        q_lines=F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD))),
    )


def measures() -> dict[str, Column]:
    return {
        "n_words": F.size("q_words"),
        "word_chars": F.char_length(F.array_join("q_words", "")),
        "n_symbols": F.regexp_count("q_text", F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": F.size("q_lines") - F.size(F.array_distinct("q_lines")),
        "n_repeat_words": repeated_words(F.col("q_words")),
    }


def default_rules() -> dict[str, Column]:
    """A text is rejected if one of these holds. The two first are the base checks."""
    m = measures()
    n, chars = m["n_words"], m["word_chars"]
    return {
        "few_words": n < LEAST_WORDS,
        "repeated_words": 100 * m["n_repeat_words"] > 20 * n,
        "symbols": 10 * m["n_symbols"] > n,
        "word_length": (chars < 2 * n) | (chars > 15 * n),
        "upper_case": 10 * F.regexp_count("q_text", F.lit(r"\p{Lu}")) > 3 * chars,
        "exclamations": 10 * F.regexp_count("q_text", F.lit("!")) > 3 * n,
        "repeated_lines": 2 * m["n_dup_lines"] > F.size("q_lines"),
        "stutter": 5 * F.size(F.filter("q_words", lambda w, i: (w == F.get("q_words", i - 1)).eqNullSafe(True))) > n,
    }


def ordered(docs: DataFrame, rules: dict[str, Column], sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names, most rejections per second first, by the first ``sample_rows`` texts."""
    rows = [(r[0],) for r in docs.select("text").take(sample_rows)]
    if not rows:
        return list(rules)
    sample = docs.sparkSession.createDataFrame(rows, "text string")
    sample = with_measures(sample.select("text", F.explode(F.sequence(F.lit(1), F.lit(SAMPLE_ROUNDS)))))

    def run(rule: Column) -> tuple[float, int]:
        start = time.perf_counter()
        hits = sample.agg(F.count_if(rule)).first()[0]
        return time.perf_counter() - start, hits

    run(F.lit(False))
    idle = run(F.lit(False))[0]
    worth = {}
    for name, rule in rules.items():
        seconds, hits = run(rule)
        worth[name] = hits / max(seconds - idle, 0.001)
    return sorted(rules, key=lambda n: (-worth[n], list(rules).index(n)))


def cascade(rules: dict[str, Column], order: list[str]) -> Column:
    """The first rule of ``order`` that rejects, null if none does; later rules are not evaluated."""
    first = None
    for name in order:
        first = F.when(rules[name], name) if first is None else first.when(rules[name], name)
    return first


def _judged(docs: DataFrame, rules: dict[str, Column] | None) -> tuple[DataFrame, list[Column]]:
    rules = rules or default_rules()
    passed, back = aside(docs)
    text = F.col(passed.columns[docs.columns.index("text")])
    measured = with_measures(passed.withColumn("text", text))
    return once(measured, failed_rule=cascade(rules, ordered(docs, rules))), back


def judged(docs: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """``docs`` with ``failed_rule``: the rule that rejects the text (the first in cascade order),
    null if none does. A column of that name is replaced, all others stay as they are.

    Null and empty texts fail few_words. Every row, repeated ones too, is judged by itself; an
    empty table stays empty.
    """
    found, back = _judged(docs, rules)
    return found.select(*[c for c, n in zip(back, docs.columns) if n != "failed_rule"], "failed_rule")


def keep_good(docs: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, all columns as they are (see :func:`judged`)."""
    found, back = _judged(docs, rules)
    return found.where("failed_rule IS NULL").select(*back)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rest = {n: r for n, r in default_rules().items() if n not in ("few_words", "repeated_words")}
    order = ordered(docs, rest)
    base = once(with_measures(docs), **{n: c.cast("long") for n, c in measures().items()})
    base_failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    kept = F.when(base_failed, False).otherwise(cascade(rest, order).isNull())
    return base.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), kept.alias("kept"))


W_SQL = r"[^\x20\x09-\x0D]+"


def kept_sql(source: str) -> str:
    """Measures and verdict of the rows of ``source`` (rid, t)."""
    return f"""
SELECT *, NOT base_failed AND 10 * n_symbols <= n_words AND word_chars BETWEEN 2 * n_words AND 15 * n_words
  AND 10 * n_upper <= 3 * word_chars AND 10 * n_exclamations <= 3 * n_words AND 2 * n_dup_lines <= n_lines
  AND 5 * n_stutter <= n_words AS kept
FROM (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 20 * n_words AS base_failed
FROM (SELECT rid, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(regexp_extract_all(t, '\\p{{Lu}}')) AS n_upper,
  len(regexp_extract_all(t, '!')) AS n_exclamations, len(l) AS n_lines,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutter,
  coalesce((SELECT count(DISTINCT i + j) FROM (SELECT unnest(p) AS i FROM (
      SELECT list(i) AS p FROM (SELECT i, w[i : i + {WINDOW - 1}] AS k FROM unnest(range(1, greatest(len(w) - {WINDOW - 2}, 1))) x(i))
      GROUP BY k HAVING count(*) > 1)), range({WINDOW}) y(j)), 0) AS n_repeat_words
FROM (SELECT rid, t, regexp_extract_all(t, '{W_SQL}') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{W_SQL}')) AS l FROM {source})))"""


SQL = f"""
WITH s AS (SELECT doc_id AS rid, coalesce(text, '') AS t FROM documents)
SELECT rid AS doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM ({kept_sql('s')})"""
