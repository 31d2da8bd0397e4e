"""Personal data: base patterns, and bootstrapped contextual extraction that grows from what they find.

Validated base matches are seed entities.  The words around an entity, one or
two to the left or right or one on both sides, are lexical patterns; patterns
and the identifier-like strings that they surround form a bipartite graph.
Scores go back and forth over it: a pattern is trusted as far as its instances
are, an instance as far as its patterns.  Instances that no base pattern
accepts, but trusted patterns surround, become further spans and support
further patterns, until a round finds nothing new.  All of it is DataFrame and
SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import discard, documents, materialise

KINDS = ("email", "ip", "card", "phone")
_GAP = "\\x20\\x09-\\x0D"
#: The base patterns of the contract.  Possessive repeats and look-behinds only keep the
#: search linear: a repeat is never followed by what it could give back, and where the
#: start of a run does not match, no later start in the same run does.
PATTERNS = {
    "email": "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++(?:\\.[0-9]++){3}+",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
#: Cheaper tests that any accepted match passes.
HINTS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "(?:[0-9][\\x20-]?){13}", "phone": "\\+[0-9]"}
#: Identifier-like: long runs of digits and marks, or words with a digit or an at sign.
_NUMBER = "(?<![^" + _GAP + "])[(+]?[0-9](?:[().-]|\\x20(?=[(0-9])|[0-9]){5,}+(?![^" + _GAP + ".,;:!?])"
_WORD = "(?:\\G|(?<![^" + _GAP + "]))[^" + _GAP + "0-9@]*+[0-9@][^" + _GAP + "]*+"
TOKEN = "|".join(f"(?:{p})" for p in (*(PATTERNS[k] for k in ("email", "phone", "ip", "card")), _NUMBER, _WORD))
#: A pattern needs so many distinct believed instances, and this score to be trusted.
MIN_SEEDS, TRUST = 5, 0.5
#: Scores are whole numbers of this part, so that the order of adding does not matter.
GRAIN = 1 << 20
_STEP = 64


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    doubled = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.when(
        i % 2 == 1, F.substr(back, i, F.lit(1)).cast("int")).otherwise(
        F.get(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substr(back, i, F.lit(1)).cast("int"))))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + v) % 10 == 0


def accepted(kind: str, match: Column) -> Column:
    """Whether a match of the kind's base pattern passes its check."""
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(match, "\\."), lambda p: (F.length(bare(p)) <= 3) & (F.concat(F.lit("0"), F.substr(
            bare(p), F.lit(1), F.lit(3))).cast("int") <= 255))
    if kind == "card":
        n = F.length(_digits(match))
        return F.when((n >= 13) & (n <= 19), _luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _around(i: Column) -> list[Column]:
    """(left, left2, right, right2): the word and the two words on either side of token ``i``, lower case, empty where there are none.

    Words are whole, however long.  A neighbouring token ends them: it counts
    as one word, its digits as 0, an address as @.
    """
    gap, word, marks = f"[{_GAP}]", f"[^{_GAP}]", "[.,;:!?)\\]]"
    plain = lambda m: F.when(m.contains("@"), F.lit("@")).otherwise(F.regexp_replace(m, "[0-9]+", "0"))
    before = F.concat(F.when(i > 0, plain(F.get("m_tokens", i - 1))).otherwise(F.lit("")), F.get("p_tokens", i))
    after = F.concat(F.get("p_tokens", i + 1), F.coalesce(plain(F.get("m_tokens", i + 1)), F.lit("")))
    tidy = lambda x: F.lower(F.regexp_replace(x, f"{gap}+", " "))
    return [tidy(F.regexp_extract(before, f"(?<!{word})({word}++){gap}*+\\z", 1)).alias("left"),
            tidy(F.regexp_extract(before, f"(?<!{word})({word}++{gap}++{word}++){gap}*+\\z", 1)).alias("left2"),
            tidy(F.regexp_extract(after, f"\\A{marks}*+{gap}*+({word}++)", 1)).alias("right"),
            tidy(F.regexp_extract(after, f"\\A{marks}*+{gap}*+({word}++{gap}++{word}++)", 1)).alias("right2")]


def _located(text: DataFrame, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds, per name, an array of (at, match), code point start and match; for ``tokens`` also the words on either side.

    Pieces between matches come from ``split``; starts are prefix sums over
    pieces and matches, formed in steps so that a text with very many matches
    stays near linear.
    """
    keep = [c for c in text.columns if c not in patterns]
    has = {n: F.col("_text").rlike(hint) for n, (_, hint) in patterns.items()}
    none = F.array().cast("array<string>")
    df = text.select(*keep, *[e for n, (p, _) in patterns.items() for e in (
        F.when(has[n], F.regexp_extract_all("_text", F.lit(p), F.lit(0))).otherwise(none).alias(f"m_{n}"),
        F.when(has[n], F.split("_text", p, -1)).otherwise(none).alias(f"p_{n}"))])
    whole = lambda a: F.aggregate(a, F.lit(0), lambda total, x: total + x)
    step = lambda i: F.floor(i / _STEP).cast("int")

    def lengths(n):
        return F.transform(f"m_{n}", lambda x, i: F.length(x) + F.length(F.get(f"p_{n}", i))).alias(f"l_{n}")

    def chunks(n):
        return F.when(F.size(f"l_{n}") > 0, F.transform(
            F.sequence(F.lit(0), step(F.size(f"l_{n}") - 1)),
            lambda c: whole(F.slice(f"l_{n}", c * _STEP + 1, F.lit(_STEP))))).otherwise(F.array().cast("array<int>")).alias(f"c_{n}")

    def before(n):
        return F.transform(f"c_{n}", lambda x, c: whole(F.slice(f"c_{n}", F.lit(1), c))).alias(f"b_{n}")

    def located(n):
        return F.transform(f"m_{n}", lambda x, i: F.struct(
            (F.get(f"b_{n}", step(i)) + whole(F.slice(f"l_{n}", step(i) * _STEP + 1, i % _STEP)) + F.length(F.get(f"p_{n}", i))).alias("at"),
            x.alias("match"), *(_around(i) if n == "tokens" else []))).alias(n)

    for part in (lengths, chunks, before):
        df = df.select("*", *map(part, patterns))
    return df.select(*keep, *map(located, patterns))


def base_spans(docs: DataFrame) -> DataFrame:
    """(row, doc_id, email, ip, card, phone, tokens): accepted base spans (start, end) per kind, and identifier-like strings.

    One row per row of ``docs`` with a number of its own; a null text is empty.
    """
    text = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    named = {k: (PATTERNS[k], HINTS[k]) for k in KINDS} | {"tokens": (TOKEN, "[0-9@]")}
    found = _located(text, named)
    place = lambda m: F.struct(m["at"].alias("start"), (m["at"] + F.length(m["match"])).alias("end"))

    def passed(kind):
        return F.transform(F.filter(kind, lambda m: accepted(kind, m["match"])), place).alias(kind)

    tokens = F.transform("tokens", lambda m: F.struct(
        m["at"].alias("start"), (m["at"] + F.length(m["match"])).alias("end"), m["match"].alias("entity"),
        m["left"].alias("left"), m["left2"].alias("left2"), m["right"].alias("right"), m["right2"].alias("right2")))
    return found.select(F.monotonically_increasing_id().alias("row"), "doc_id", *map(passed, KINDS), tokens.alias("tokens"))


def seed_kind(entity: Column) -> Column:
    """The kind whose base pattern the whole string matches and passes; null for others."""
    kind = F.lit(None).cast("string")
    for k in reversed(KINDS):
        kind = F.when(F.when(entity.rlike(f"^(?:{PATTERNS[k]})$"), accepted(k, entity)).otherwise(False), F.lit(k)).otherwise(kind)
    return kind


def plausible(kind: Column, entity: Column) -> Column:
    """Whether a string that is no base match may still be an identifier of the kind."""
    n = F.length(_digits(entity))
    return F.when(kind == "email", entity.contains("@") | entity.rlike("(?i)[(\\[]at[)\\]]")) \
        .when(kind == "ip", entity.rlike("^[^0-9]*[0-9]+(?:[.:-][0-9]+){3,}[^0-9]*$")) \
        .when(kind == "card", (n >= 12) & (n <= 19)).otherwise((n >= 7) & (n <= 15))


def contexts() -> Column:
    """The patterns (side, context) around a mention: one and two words on either side, and one on both.

    A pattern holds a letter; marks and numbers alone are next to anything.
    """
    both = F.when((F.col("left") != "") & (F.col("right") != ""), F.concat_ws(" ", "left", "right")).otherwise(F.lit(""))
    sides = (("l", F.col("left")), ("ll", F.col("left2")), ("r", F.col("right")), ("rr", F.col("right2")), ("b", both))
    return F.filter(F.array(*[F.struct(F.lit(n).alias("side"), c.alias("context")) for n, c in sides]), lambda p: p["context"].rlike("\\p{L}"))


def induce(mentions: DataFrame, trust: float = TRUST, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """(side, context, kind): the patterns trusted at the end of the bootstrap over (entity, seed, left, left2, right, right2).

    Seeds are believed with score 1.  A round scores each pattern by the sum of
    its believed distinct instances over all its distinct instances and one
    more, where those that could be of the kind but are not believed count
    half, and trusts it from ``trust`` on if ``min_seeds`` of them are believed;
    then each plausible instance of a trusted pattern is believed with the best
    score of its patterns.  What is believed stays so with the score that it
    began with, so no pattern lifts itself.  Rounds end when one finds nobody
    new; every round but the last believes at least one more string.
    """
    edges = materialise(mentions.select("entity", "seed", F.explode(contexts()).alias("p")).select(
        "p.side", "p.context", "entity", "seed").distinct(), "edges")
    here = (F.col("side") == F.col("s")) & (F.col("context") == F.col("c"))
    # a pattern with fewer instances can never have enough that are believed
    wide = edges.groupBy(F.col("side").alias("s"), F.col("context").alias("c")).agg(F.count("*").alias("n")).where(F.col("n") >= min_seeds)
    kinds = F.when(F.col("seed").isNotNull(), F.array("seed")).otherwise(F.filter(
        F.array(*map(F.lit, KINDS)), lambda k: F.coalesce(plausible(k, F.col("entity")), F.lit(False))))
    graph = materialise(edges.join(wide, here).select(
        "side", "context", "n", "entity", F.col("seed").isNotNull().alias("own"), F.explode(kinds).alias("kind")), "graph")
    believed = materialise(graph.where("own").select(F.col("entity").alias("e"), F.col("kind").alias("k"), F.lit(GRAIN).cast("long").alias("score")).distinct(), "believed")
    discard(edges)
    known = (F.col("entity") == F.col("e")) & (F.col("kind") == F.col("k"))
    while True:
        patterns = materialise(graph.join(believed, known, "left").groupBy("side", "context", "kind").agg(
            F.sum("score").alias("total"), F.count("score").alias("instances"), F.count("*").alias("possible"), F.first("n").alias("n")).select(
            F.col("side").alias("s"), F.col("context").alias("c"), F.col("kind").alias("of"), "instances",
            F.floor(2 * F.col("total") / (2 * (F.col("n") + 1) - (F.col("possible") - F.col("instances")))).alias("worth")).where(
            (F.col("instances") >= min_seeds) & (F.col("worth") >= trust * GRAIN)), "patterns")
        found = graph.where(~F.col("own")).join(patterns, here & (F.col("kind") == F.col("of"))).groupBy("entity", "kind").agg(
            F.max("worth").alias("score"))
        new = materialise(found.join(believed.select("e", "k"), known, "left_anti").select(
            F.col("entity").alias("e"), F.col("kind").alias("k"), "score"), "new")
        if new.isEmpty():
            discard(graph)
            return patterns.select(F.col("s").alias("side"), F.col("c").alias("context"), F.col("of").alias("kind"))
        before, believed = believed, materialise(believed.union(new), "believed")
        discard(before)
        discard(new)
        discard(patterns)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, email, ip, card, phone, found): base spans per kind and the further spans (kind, start, end).

    Null and empty texts have none; rows that repeat each get their own; an
    empty table gives an empty result.  A further span never overlaps a base
    span of the same text.  Starts and ends count code points.
    """
    spans = materialise(base_spans(docs), "spans")
    mention = spans.select("row", F.explode("tokens").alias("t")).select("row", "t.*")
    mention = materialise(mention.withColumn("seed", seed_kind(F.col("entity"))), "mentions")
    trusted = materialise(induce(mention), "trusted")
    around = mention.where(F.col("seed").isNull()).select("row", "start", "end", "entity", F.explode(contexts()).alias("p")).select(
        "row", "start", "end", "entity", "p.side", "p.context")
    hits = around.join(trusted.select(F.col("side").alias("s"), F.col("context").alias("c"), "kind"),
                       (F.col("side") == F.col("s")) & (F.col("context") == F.col("c"))).where(
        plausible(F.col("kind"), F.col("entity")))
    rank = F.element_at(F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))]), F.col("kind"))
    found = hits.groupBy("row", "start", "end").agg(F.min(rank).alias("rank")) \
        .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "start", "end"))).alias("more"))
    base = F.concat(*KINDS)
    more = F.filter(F.coalesce("more", F.array().cast("array<struct<rank:int,start:int,end:int>>")), lambda s: ~F.exists(
        base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return spans.join(found.withColumnRenamed("row", "of"), F.col("row") == F.col("of"), "left").select(
        "doc_id", *KINDS, more.alias("found"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all ``documents``: counts and a digest of base spans, and all spans."""
    found = find(documents(spark, sf_dir))
    written = lambda kind, spans: F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    def both(rank, kind):
        more = F.transform(F.filter("found", lambda s: s["rank"] == rank), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
        return written(kind, F.array_sort(F.concat(F.col(kind), more)))

    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.concat_ws(",", *[written(k, F.col(k)) for k in KINDS]), 256).alias("base_sha256"),
        F.concat_ws(",", *[both(i, k) for i, k in enumerate(KINDS)]).alias("spans"), F.size("found").cast("long").alias("n_found"))
