"""String Column builders (all JVM-side, codegen friendly)."""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nz(c) -> Column:
    """NULL -> '' (missing text is the empty string in the data model)."""
    return F.coalesce(col_(c).cast("string"), F.lit(""))


def strip_ws(c) -> Column:
    """Trim leading/trailing whitespace (spaces, tabs, CR/LF), not only spaces."""
    return F.regexp_replace(col_(c), r"^\s+|\s+$", "")


def contains_any(c, words: Iterable[str]) -> Column:
    """OR of literal substring tests; ``c`` should already be lower-cased."""
    c = col_(c)
    tests = [c.contains(w) for w in words]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def contains_all(c, words: Iterable[str]) -> Column:
    c = col_(c)
    tests = [c.contains(w) for w in words]
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def py_bool(c) -> Column:
    """Boolean rendered the way the reports print it (``True`` / ``False``)."""
    return F.when(col_(c), F.lit("True")).otherwise(F.lit("False"))


def py_list(arr) -> Column:
    """Array of plain strings rendered as ``['a', 'b']``."""
    arr = col_(arr)
    return F.when(F.size(arr) == 0, F.lit("[]")).otherwise(
        F.concat(F.lit("['"), F.array_join(arr, "', '"), F.lit("']")))


def compress_text(c, max_len: int = 800) -> Column:
    """Cut long text to ``max_len`` characters and say how much was cut."""
    c = nz(c)
    n = F.length(c)
    return F.when(n > max_len, F.concat(
        F.substring(c, 1, max_len), F.lit("… (+"), (n - max_len).cast("string"), F.lit(" chars)"))
    ).otherwise(c)


def file_safe_key(c) -> Column:
    """User name -> file-safe key (``@`` -> ``_at_``, ``/`` -> ``_``)."""
    return F.regexp_replace(F.regexp_replace(col_(c), "@", "_at_"), "/", "_")


def ref(file_id, rownum) -> Column:
    """Row provenance reference ``file_id:rownum``."""
    return F.concat_ws(":", col_(file_id).cast("string"), col_(rownum).cast("string"))


def concat_str(*parts) -> Column:
    """concat() where plain Python strings become literals."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def opt_part(cond: Column, *parts) -> Column:
    """``parts`` concatenated when ``cond`` holds, else ''."""
    return F.when(cond, concat_str(*parts)).otherwise(F.lit(""))


def lower_join(cols: Sequence, sep: str = " ") -> Column:
    return F.lower(F.concat_ws(sep, *[nz(c) for c in cols]))
