"""Column -> Column scalar functions. All are native Catalyst expressions (no Python UDF)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def clip(x, lo=None, hi=None) -> Column:
    """Null-preserving clip (bare greatest/least would turn null into a bound)."""
    x = _c(x)
    out = x
    if lo is not None:
        out = F.greatest(out, _c(lo))
    if hi is not None:
        out = F.least(out, _c(hi))
    return F.when(x.isNull(), F.lit(None)).otherwise(out)


def safe_divide(a, b, default=None) -> Column:
    """a / b with zero or null denominator -> ``default`` (null if not given)."""
    q = F.try_divide(_c(a), F.nullif(_c(b), F.lit(0)))
    return q if default is None else F.coalesce(q, _c(default))


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def flag(x, truthy: str = "Y") -> Column:
    """(x == 'Y') as int with null -> 0 (null-safe equality)."""
    return _c(x).eqNullSafe(F.lit(truthy)).cast("int")


def risk_band(pd_col) -> Column:
    p = _c(pd_col)
    expr = None
    for cut, name in K.BAND_CUTS:
        expr = F.when(p < cut, F.lit(name)) if expr is None else expr.when(p < cut, F.lit(name))
    return F.when(p.isNull(), F.lit(None)).otherwise(expr.otherwise(F.lit(K.BAND_TOP)))


def risk_score(pd_col) -> Column:
    """int(round(pd * 100)) with half-even rounding."""
    return F.bround(_c(pd_col) * 100, 0).cast("int")


def round_half_even(x, places: int) -> Column:
    """Rounding to ``places`` decimals, halves to the even digit."""
    return F.bround(_c(x), places)


def title_case(s) -> Column:
    """Upper case after every character that is no letter, lower case elsewhere ("home-improvement" -> "Home-Improvement")."""
    runs = F.regexp_extract_all(_c(s), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), "")


def map_lookup(key, mapping: Mapping, default=None) -> Column:
    """Literal-map lookup (unmapped -> default / null); folded into the projection."""
    items = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    found = F.try_element_at(F.create_map(*items), _c(key))
    return found if default is None else F.coalesce(found, F.lit(default))


def grade_encode(grade) -> Column:
    return map_lookup(grade, K.GRADE_MAP).cast("int")


def grade_decode(ordinal) -> Column:
    inverse = {v: k for k, v in K.GRADE_MAP.items()}
    letter = map_lookup(_c(ordinal).cast("int"), inverse)
    return F.concat(F.lit("Grade "), F.coalesce(letter, F.lit("?")))


def substring_count(text, term: str) -> Column:
    """Non-overlapping occurrences of ``term`` in ``text`` (Python ``str.count``)."""
    t = F.coalesce(_c(text), F.lit(""))
    return ((F.length(t) - F.length(F.replace(t, F.lit(term), F.lit("")))) / F.lit(len(term))).cast("long")


def lexicon_count(text, terms: Iterable[str]) -> Column:
    total = None
    for w in terms:
        c = substring_count(text, w)
        total = c if total is None else total + c
    return total if total is not None else F.lit(0).cast("long")


def contains_any(text, words: Iterable[str]) -> Column:
    t = _c(text)
    out = None
    for w in words:
        c = F.contains(t, F.lit(w))
        out = c if out is None else (out | c)
    return out


def dot(a, b) -> Column:
    """Dot product of two equal-length numeric arrays."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def l2_normalise(a) -> Column:
    arr = _c(a)
    norm = F.sqrt(F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))
    return F.transform(arr, lambda v: v.cast("double") / norm)


def bool_to_double(pred: Column) -> Column:
    return pred.cast("double")


def to_int_trunc(x) -> Column:
    return _c(x).cast("int")


def try_number(x) -> Column:
    """Numeric coercion with bad values -> null (pandas to_numeric(errors='coerce'))."""
    return F.expr(f"try_cast(`{x}` as double)") if isinstance(x, str) else x.try_cast("double")


def nan_to_null(x) -> Column:
    c = _c(x)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def linspace_value(i, start: float, stop: float, num: int) -> Column:
    """numpy.linspace element i: start + i*step, last element exactly ``stop``."""
    step = (stop - start) / (num - 1)
    i = _c(i)
    return F.when(i == num - 1, F.lit(stop)).otherwise(F.lit(start) + i.cast("double") * F.lit(step))
