"""Quality rules: a threshold table compiled into Spark projections of length, symbol, stop-word and line ratios."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import WORD_PATTERN, documents

SYMBOLS = "#*$%&|<>"
SPACE_PATTERN = "[\\x20\\x09-\\x0D]+"
WINDOW = 5
#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the be to of and that have with is in it for was on are as by this at from or an not "
    "der die das und ist von zu den mit auf für ein eine im sich nicht als des dem auch "
    "de la le les et un une en est que qui dans pour sur pas au par du avec plus "
    "el los las y se por con para su al lo del como es una no"
).split()


@dataclass(frozen=True)
class Rule:
    """Reject a text of at least ``words`` words whose top / bottom lies outside [low, high]."""

    name: str
    top: str
    bottom: str
    low: float | None = None
    high: float | None = None
    words: int = 0


#: The table; a ratio with a zero bottom never rejects.
RULES = (
    Rule("word_length", "word_chars", "n_words", low=2.0, high=12.0),
    Rule("symbols_to_words", "n_symbols", "n_words", high=0.1),
    Rule("stop_words", "n_stop_words", "n_words", low=0.03, words=50),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.4),
    Rule("upper_case", "n_upper", "word_chars", high=0.5),
    Rule("exclamations", "n_exclamations", "n_words", high=0.3),
)
#: Fixed by the contract of the base verdict.
MIN_WORDS, MAX_REPEATED_PERCENT = 10, 20


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` plus the measured columns, in a struct ``_m`` so that no column name of ``docs`` can clash.

    A null text counts as one without words.  Windows and lines are compared
    by 64-bit hashes.  Everything is built-in array functions, in one stage.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    words = F.filter(F.split(text, SPACE_PATTERN, -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD_PATTERN))
    stop = [f for w in STOP_WORDS for f in dict.fromkeys((w, w.capitalize(), w.upper()))]
    step = docs.select(own, text.alias("_text"), words.alias("_words"), F.transform(lines, lambda x: F.xxhash64(x)).alias("_lines"))
    step = step.select("_row", "_text", "_lines", "_words", F.transform("_words", lambda w: F.xxhash64(w)).alias("_hash"))
    window = F.when(F.size("_hash") >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size("_hash") - WINDOW),
        lambda i: F.xxhash64(*[F.get("_hash", i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    step = step.select("_row", "_text", "_lines", "_words", window.alias("_grams"))
    ordered = F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), F.sort_array(
        F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))).otherwise(
        F.array().cast("array<struct<g:bigint,i:int>>"))
    step = step.select("_row", "_text", "_lines", "_words", ordered.alias("_order"))
    again = F.filter(F.transform("_order", lambda x, k: F.when(
        (F.get(F.col("_order"), k - 1)["g"] == x["g"]) | (F.get(F.col("_order"), k + 1)["g"] == x["g"]), x["i"])),
        lambda p: p.isNotNull())
    step = step.select("_row", "_text", "_lines", "_words", F.sort_array(again).alias("_again"))
    covered = F.aggregate(F.transform("_again", lambda p, k: F.least(
        F.lit(WINDOW), F.coalesce(F.get("_again", k + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    count = lambda pattern: F.length(F.regexp_replace("_text", pattern, "")).cast("long")
    return step.select("_row", F.struct(
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        count(f"[^{SYMBOLS}]+").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size(F.filter("_words", lambda w: w.isin(stop))).cast("long").alias("n_stop_words"),
        count("\\P{Lu}+").alias("n_upper"),
        count("[^!]+").alias("n_exclamations")).alias("_m"))


def base_failed() -> Column:
    m = F.col("_m")
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEATED_PERCENT * m["n_words"])


def rejections(rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that reject, as one array expression compiled from the table."""
    m, names = F.col("_m"), []
    for r in rules:
        ratio = F.try_divide(m[r.top].cast("double"), m[r.bottom].cast("double"))
        out = F.lit(False)
        if r.low is not None:
            out |= ratio < r.low
        if r.high is not None:
            out |= ratio > r.high
        names.append(F.when(F.coalesce(out, F.lit(False)) & (m["n_words"] >= r.words), F.lit(r.name)))
    return F.array_compact(F.array(*names))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(_row, _m, base_failed, reasons, kept) of every row of ``docs``."""
    judged = measures(docs).select("_row", "_m", base_failed().alias("base_failed"), rejections(rules).alias("reasons"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, all columns unchanged; empty and null texts are rejected."""
    # the running number keeps the optimiser from moving the filter below the projections that measure,
    # which would write out every measure anew wherever another one uses it
    return judge(docs, rules).withColumn("_at", F.monotonically_increasing_id()).where("kept and _at >= 0").select("_row.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict for all ``documents``."""
    return judge(documents(spark, sf_dir)).select(
        "_row.doc_id", "_m.n_words", "_m.word_chars", "_m.n_symbols", "_m.n_dup_lines", "_m.n_repeat_words", "base_failed", "kept",
        "_m.n_lines", "_m.n_stop_words", "_m.n_upper", "_m.n_exclamations", F.array_join("reasons", ",").alias("reasons"))


def oracle() -> str:
    """The query in DuckDB SQL, the rules from the same table."""
    stop = ", ".join(f"'{f}'" for w in STOP_WORDS for f in dict.fromkeys((w, w.capitalize(), w.upper())))
    cases = []
    for r in RULES:
        ratio = f"{r.top}::DOUBLE / nullif({r.bottom}, 0)"
        tests = [f"{ratio} < {r.low}"] * (r.low is not None) + [f"{ratio} > {r.high}"] * (r.high is not None)
        cases.append(f"CASE WHEN coalesce({' OR '.join(tests)}, false) AND n_words >= {r.words} THEN '{r.name}' END")
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text,
             list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD_PATTERN}')) AS lines
           FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM t),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(words[i:i + 4], ' ')) AS n FROM g),
r AS (SELECT doc_id, i, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5) AS gap FROM c WHERE n > 1),
w AS (SELECT doc_id, sum(least(gap, 5)) AS n_repeat_words FROM r GROUP BY doc_id),
m AS (SELECT t.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^{SYMBOLS}]+', '', 'g'))::BIGINT AS n_symbols,
        len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        len(list_filter(words, lambda w: w IN ({stop})))::BIGINT AS n_stop_words,
        length(regexp_replace(text, '\\P{{Lu}}+', '', 'g'))::BIGINT AS n_upper,
        length(regexp_replace(text, '[^!]+', '', 'g'))::BIGINT AS n_exclamations
      FROM t LEFT JOIN w USING (doc_id)),
v AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words) AS base_failed,
        concat_ws(',', {', '.join(cases)}) AS reasons FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND reasons = '' AS kept, n_lines, n_stop_words, n_upper, n_exclamations, reasons FROM v"""
