"""JSON-derived Column builders: OAuth scopes and AuditData operation fallback."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .text import col_, contains_any, nz


def json_object_text(text) -> Column:
    """Lower-cased re-serialised JSON when ``text`` is a JSON object, else NULL."""
    v = F.try_parse_json(nz(text))
    is_obj = F.schema_of_variant(v).startswith("OBJECT")
    return F.when(v.isNotNull() & is_obj, F.lower(F.to_json(v)))


def may_hold_scopes(text) -> Column:
    """Cheap exact pre-test: serialised JSON can only yield scopes when the raw text
    (lower-cased) holds ``scope``, a dangerous scope name, or a ``\\u`` escape."""
    t = F.lower(nz(text))
    return contains_any(t, ["scope", "\\u"] + list(K.DANGEROUS_OAUTH_SCOPES))


def scope_json_text(text) -> Column:
    """``json_object_text`` only for rows that pass ``may_hold_scopes`` (NULL otherwise)."""
    return F.when((nz(text) != "") & may_hold_scopes(text), json_object_text(text))


def oauth_scopes(auditdata="auditdata", json_text=None) -> Column:
    """Sorted distinct scope strings found in a JSON-object AuditData.

    Captures ``scope(s)[:=]"..."`` values split on blanks/commas (1..60 chars)
    plus every dangerous scope that appears anywhere in the text.  Pass
    ``json_text`` (a column holding ``json_object_text(auditdata)``) so the
    JSON is parsed once per row; the text is referenced inside lambdas where
    no common-subexpression elimination happens.
    """
    txt = col_(json_text) if json_text is not None else json_object_text(auditdata)
    caps = F.regexp_extract_all(txt, F.lit(K.SCOPE_PATTERN), 1)
    parts = F.flatten(F.transform(caps, lambda c: F.split(c, K.SCOPE_SPLIT_PATTERN)))
    parts = F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    parts = F.filter(parts, lambda p: (F.length(p) >= 1) & (F.length(p) <= K.SCOPE_MAX_LEN))
    known = F.array(*[F.lit(s) for s in K.DANGEROUS_OAUTH_SCOPES])
    found = F.filter(known, lambda s: F.contains(txt, s))
    scopes = F.array_sort(F.array_distinct(F.concat(parts, found)))
    return F.when(txt.isNull(), F.array().cast("array<string>")).otherwise(scopes)


def dangerous_scopes(scopes: Column) -> Column:
    known = F.array(*[F.lit(s) for s in K.DANGEROUS_OAUTH_SCOPES])
    return F.filter(scopes, lambda s: F.array_contains(known, s))


def operation_fallback(operation="operation", auditdata="auditdata") -> Column:
    """Empty operation -> ``$.Operation`` of a JSON-object AuditData."""
    op = nz(operation)
    v = F.try_parse_json(nz(auditdata))
    from_json = F.when(F.schema_of_variant(v).startswith("OBJECT"),
                       F.try_variant_get(v, "$.Operation", "string"))
    return F.when(op == "", F.coalesce(from_json, F.lit(""))).otherwise(op)


def _json_string(c: Column) -> Column:
    """A string Column as a JSON string literal (quoted, escaped)."""
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


def compress_evidence(evidence_json, max_len: int = 800) -> Column:
    """Trim each top-level evidence value (``fn_compress_evidence``).

    String values longer than ``max_len`` are cut with the ``… (+k chars)``
    marker; other values stay as they are unless their JSON text is longer
    than ``max_len``, in which case the trimmed text replaces them.  Key
    order is kept.
    """
    from .text import compress_text
    ev = nz(evidence_json)
    as_variant = F.from_json(ev, "map<string,variant>")
    as_text = F.from_json(ev, "map<string,string>")
    keys = F.json_object_keys(ev)

    def entry(k):
        txt = F.element_at(as_text, k)
        is_str = F.schema_of_variant(F.element_at(as_variant, k)) == "STRING"
        trimmed = _json_string(compress_text(txt, max_len))
        val = (F.when(txt.isNull(), F.lit("null")).when(is_str, trimmed)
               .when(F.length(txt) > max_len, trimmed).otherwise(txt))
        return F.concat(_json_string(k), F.lit(": "), val)

    return F.when(keys.isNull(), F.lit("{}")).otherwise(
        F.concat(F.lit("{"), F.array_join(F.transform(keys, entry), ", "), F.lit("}")))
