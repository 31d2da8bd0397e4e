"""User-defined rules: ``contains_any`` AND ``contains_all`` AND ``regex`` over a row text.

Rules are configuration (a list given by the analyst).  A short one is
compiled into Column expressions: one pass over the events evaluates every
rule, builds the array of matching rule indexes and explodes it, without a join,
and the literal ``contains`` tests run before any regex.  Of a long one, the
rules that cannot match without some literal go through an inverted index: the
rarest gram of each such literal is joined with the grams of the row texts, and
only the rules that a row meets there are evaluated on it.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import contains_all, contains_any, nz
from ..schema import FINDING_COLUMNS, exploded_findings, finding_columns
from .lookup import with_file_sha

#: Rules that a DataFrame may bring to the driver; more are an error.
MAX_RULES = 1_000_000
#: More rules with literals than this are looked up by their grams.
COMPILED_RULES = 64
#: Characters of a gram.
GRAM = 3


@dataclass
class Rule:
    name: str
    family: str
    severity: str
    category: str
    title: str
    description: str
    contains_any: list = field(default_factory=list)
    contains_all: list = field(default_factory=list)
    regex: str | None = None
    source: dict = field(default_factory=dict)


def _s(v, default):
    return default if v is None else str(v)


def validate_rules(rules) -> list[Rule]:
    """Keep rule dicts that have a ``name``; fill defaults (``rules_validate``).

    Accepts a list of dicts, a ``{"rules": [...]}`` dict, or a DataFrame of
    rules (``name, family, severity, category, title, description,
    contains_any, contains_all, regex``) that is checked to be small first.
    """
    if isinstance(rules, DataFrame):
        rows = rules.limit(MAX_RULES + 1).collect()
        if len(rows) > MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules")
        rules = [_row_to_rule_dict(r.asDict(recursive=True)) for r in rows]
    if isinstance(rules, dict) and "rules" in rules:
        rules = rules["rules"]
    out = []
    for r in rules or []:
        if not isinstance(r, dict) or r.get("name") is None:
            continue
        m = r.get("match") or {}
        title = _s(r.get("title"), _s(r.get("name"), K.RULE_DEFAULT_TITLE)).strip()
        out.append(Rule(
            name=_s(r.get("name"), title).strip(),
            family=_s(r.get("family"), "").lower().strip(),
            severity=_s(r.get("severity"), K.RULE_DEFAULT_SEVERITY).lower().strip(),
            category=_s(r.get("category"), K.RULE_DEFAULT_CATEGORY).strip(),
            title=title,
            description=_s(r.get("description"), ""),
            contains_any=[str(x) for x in (m.get("contains_any") or [])],
            contains_all=[str(x) for x in (m.get("contains_all") or [])],
            regex=m.get("regex") or None,
            source=r,
        ))
    return out


def _row_to_rule_dict(d: dict) -> dict:
    match = {k: d.get(k) for k in ("contains_any", "contains_all", "regex") if d.get(k) is not None}
    out = {k: d.get(k) for k in ("name", "family", "severity", "category", "title", "description")
           if d.get(k) is not None}
    out["match"] = match
    return out


def rule_predicate(rule: Rule, text: Column, text_lower: Column) -> Column:
    cond = F.lit(True)
    if rule.contains_any:
        cond = cond & contains_any(text_lower, [w.lower() for w in rule.contains_any])
    if rule.contains_all:
        cond = cond & contains_all(text_lower, [w.lower() for w in rule.contains_all])
    if rule.regex:
        cond = cond & text.rlike("(?i)" + rule.regex)
    return cond


SIGNIN_TEXT = ["app", "client_app", "status", "result_type", "error_code", "failure_reason", "raw_json"]
UAL_TEXT = ["operation", "auditdata"]


def _rule_columns(name, severity, category, title, description, source, ev_cols: list[str]) -> list[Column]:
    ev = F.struct(F.parse_json(source).alias("rule"), *[nz(c).alias(c) for c in ev_cols])
    return finding_columns(
        finding_id=F.concat(F.lit("RULE-"), name, F.lit("-"), F.col("file_id").cast("string"), F.lit("-"),
                            F.col("rownum").cast("string")),
        severity=severity, category=category, title=title, timestamp=nz("ts_iso"), user=nz("user"),
        ip=nz("ip"), country="", file=F.col("file_id").cast("string"), rownum=F.col("rownum").cast("string"),
        sha256=nz("sha256"), details=description, evidence=ev)


def _fields(r: Rule) -> tuple:
    return r.name, r.severity, r.category, r.title, r.description, json.dumps(r.source, ensure_ascii=False, default=str)


def with_rule_text(rows: DataFrame, text_cols: list[str]) -> DataFrame:
    """Add the text that rules see (``_t``) and its lower case (``_tl``)."""
    return (rows.withColumn("_t", F.concat_ws("\n", *[nz(c) for c in text_cols]))
            .withColumn("_tl", F.lower(F.col("_t"))))


def rule_items(rows: DataFrame, rules: list[Rule], text_cols: list[str], ev_cols: list[str], no: int):
    """Add the rule text columns to ``rows``; return (rows, items of ``exploded_findings``)."""
    rows = with_rule_text(rows, text_cols)
    items = [(no, rule_predicate(r, F.col("_t"), F.col("_tl")), _rule_columns(*map(F.lit, _fields(r)), ev_cols)) for r in rules]
    return rows, items


def required_runs(regex: str) -> list[str]:
    """Lower-case ASCII runs that any match of the regex holds; none where groups, classes or choices leave that open."""
    if not regex.isascii() or re.search(r"[|()\[\]{}\\]", regex):
        return []
    runs = re.finditer(r"[A-Za-z0-9 _@:=,;/-]+", regex)
    return [(m.group()[:-1] if regex[m.end():m.end() + 1] in ("?", "*") else m.group()).lower() for m in runs]


def anchors(rule: Rule) -> list[str]:
    """Lower-case literals of GRAM characters or more, one of which every matching text holds; empty where none are sure."""
    choices = [[w.lower()] for w in rule.contains_all] + [[w] for w in required_runs(rule.regex or "")]
    if rule.contains_any:
        choices.append([w.lower() for w in rule.contains_any])
    usable = [c for c in choices if min(map(len, c)) >= GRAM]
    return max(usable, key=lambda c: (min(map(len, c)), -len(c)), default=[])


def split_rules(rules: list[Rule]) -> tuple[list[Rule], list[Rule]]:
    """(compiled, looked up): few rules are all compiled, of many those without anchors."""
    anchored = [r for r in rules if anchors(r)]
    if len(anchored) <= COMPILED_RULES:
        return rules, []
    return [r for r in rules if not anchors(r)], anchored


def indexed_findings(df: DataFrame, rules: list[Rule], text_cols: list[str], ev_cols: list[str], files) -> DataFrame:
    """Findings of rules that have anchors, by an inverted index of the anchors' rarest grams.

    A gram's frequency is the number of rows that hold it, among the grams of
    the anchors.  Rows travel as (file_id, rownum) until the rules that share a
    gram with them are known, at most one number per rule; equal keys share
    their candidates, each row is then verified on its own text.
    """
    spark = df.sparkSession
    table = spark.createDataFrame(
        [(i, *_fields(r), [w.lower() for w in r.contains_any], [w.lower() for w in r.contains_all], "(?i)" + r.regex if r.regex else None)
         for i, r in enumerate(rules)],
        "_no int, _name string, _severity string, _category string, _title string, _description string, _source string, "
        "_any array<string>, _all array<string>, _regex string")
    grams = spark.createDataFrame(
        sorted({(i, w, w[at:at + GRAM]) for i, r in enumerate(rules) for w in anchors(r) for at in range(len(w) - GRAM + 1)}),
        "rule int, word string, gram string")
    rows = with_rule_text(df, text_cols)
    held = rows.select("file_id", "rownum", F.explode(F.array_distinct(
        F.regexp_extract_all("_tl", F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))).alias("held"))
    wanted = grams.select(F.col("gram").alias("wanted")).distinct()
    common = held.join(wanted, F.col("held") == F.col("wanted")).groupBy("wanted").agg(F.count("*").alias("n"))
    rarest = grams.join(common, F.col("gram") == F.col("wanted"), "left").groupBy("rule", "word").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least")).select("rule", F.col("least.gram").alias("key")).distinct()
    met = held.join(rarest, F.col("held") == F.col("key")).groupBy(
        F.col("file_id").alias("_file"), F.col("rownum").alias("_rownum")).agg(F.collect_set("rule").alias("_met"))
    same = F.col("file_id").eqNullSafe(F.col("_file")) & F.col("rownum").eqNullSafe(F.col("_rownum"))
    pairs = rows.join(met, same).withColumn("_rule", F.explode("_met")).join(table, F.col("_rule") == F.col("_no"))
    matches = pairs.where(
        ((F.size("_any") == 0) | F.exists("_any", lambda w: F.col("_tl").contains(w)))
        & F.forall("_all", lambda w: F.col("_tl").contains(w))
        & (F.col("_regex").isNull() | F.regexp_like("_t", F.col("_regex"))))
    fields = [F.col(c) for c in ("_name", "_severity", "_category", "_title", "_description", "_source")]
    return with_file_sha(matches, files).select(*_rule_columns(*fields, ev_cols))


def _apply(df: DataFrame, rules: list[Rule], text_cols: list[str], ev_cols: list[str], files) -> DataFrame:
    compiled, looked_up = split_rules(rules)
    found = indexed_findings(df, looked_up, text_cols, ev_cols, files) if looked_up else None
    if not compiled:
        return found
    rows, items = rule_items(with_file_sha(df, files), compiled, text_cols, ev_cols, 10)
    tried = exploded_findings(rows, items).select(*FINDING_COLUMNS)
    return tried if found is None else tried.unionByName(found)


def det_rules_ual(ual: DataFrame, rules, files: DataFrame | None = None) -> DataFrame | None:
    rs = [r for r in validate_rules(rules) if r.family == "ual"]
    if not rs:
        return None
    return _apply(ual, rs, UAL_TEXT, ["operation"], files)


def det_rules_signin(signin: DataFrame, rules, files: DataFrame | None = None) -> DataFrame | None:
    rs = [r for r in validate_rules(rules) if r.family == "signin"]
    if not rs:
        return None
    return _apply(signin, rs, SIGNIN_TEXT, ["app", "client_app"], files)


def det_rules(signin: DataFrame, ual: DataFrame, rules, files: DataFrame | None = None) -> DataFrame | None:
    parts = [p for p in (det_rules_ual(ual, rules, files), det_rules_signin(signin, rules, files)) if p is not None]
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rules_frame(spark, rules) -> DataFrame:
    """Validated rules as a DataFrame (for inspection / sinks)."""
    rs = validate_rules(rules)
    schema = ("name string, family string, severity string, category string, title string, description string, "
              "contains_any array<string>, contains_all array<string>, regex string")
    return spark.createDataFrame(
        [(r.name, r.family, r.severity, r.category, r.title, r.description, r.contains_any or None,
          r.contains_all or None, r.regex) for r in rs], schema)
