"""Scalar functions on strings, numbers and small vectors, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- strings ----------------------------------------------------------------


def strchr_replace(text: str | Column, old: str, new: str) -> Column:
    """Map characters; those of ``old`` beyond ``new`` vanish."""
    return F.translate(_col(text), old, new)


def regex_replace(text: str | Column, pattern: str, to: str, options: str = "") -> Column:
    """``s/pattern/to/options``; options: ``g``, all matches, ``i``, ignoring case."""
    java = ("(?i)" if "i" in options else "") + pattern
    if "g" in options:
        return F.regexp_replace(_col(text), java, to)
    shifted = re.sub(r"\$(\d)", lambda m: f"${int(m[1]) + 1}" if m[1] != "0" else "$2", to)
    flags, body = ("(?i)", pattern) if "i" in options else ("", pattern)
    return F.regexp_replace(_col(text), f"{flags}\\A((?s:.*?))({body})" if "$0" in to else f"{flags}\\A((?s:.*?))(?:{body})", f"$1{shifted}")


def regex_count(text: str | Column, pattern: str, ignore_case: bool = False) -> Column:
    """One more than the number of matches."""
    return F.regexp_count(_col(text), F.lit(("(?i)" if ignore_case else "") + pattern)) + 1


def trim_tail(text: str | Column, chars: str) -> Column:
    return F.rtrim(_col(text), F.lit(chars))


def trim_head(text: str | Column, chars: str) -> Column:
    return F.ltrim(_col(text), F.lit(chars))


def upper(text: str | Column) -> Column:
    return F.upper(_col(text))


def lower(text: str | Column) -> Column:
    return F.lower(_col(text))


def equal_ignoring_case(a: str | Column, b: str | Column) -> Column:
    return F.lower(_col(a)) == F.lower(_col(b))


def compare_from_end(a: str | Column, b: str | Column) -> Column:
    """-1, 0 or 1, by the reversed strings."""
    x, y = F.reverse(_col(a)), F.reverse(_col(b))
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def time_to_string(ts: str | Column) -> Column:
    return F.date_format(_col(ts), "MM/dd/yyyy HH:mm:ss")


def string_to_time(text: str | Column) -> Column:
    """Seconds since the epoch; -1 where the text is no time, 0 where the time is before the epoch."""
    seconds = F.unix_timestamp(F.try_to_timestamp(_col(text), F.lit("MM/dd/yyyy HH:mm:ss")))
    return F.when(seconds < 0, 0).otherwise(F.coalesce(seconds, F.lit(-1)))


def string_id(text: str | Column, ids: dict[str, int]) -> Column:
    """The id of a string, -1 where it has none."""
    pairs = [F.lit(x) for item in ids.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), _col(text)), F.lit(-1)) if pairs else F.lit(-1)


def tokenize(text: str | Column, delimiters: str) -> Column:
    """The non-empty pieces between delimiter characters."""
    return F.filter(F.split(_col(text), f"[{re.escape(delimiters)}]+"), lambda x: x != "")


def base64_encode(text: str | Column) -> Column:
    return F.base64(_col(text).cast("binary"))


def base64_decode(text: str | Column) -> Column:
    return F.unbase64(_col(text))


def split_count(text: str | Column, delimiters: str) -> Column:
    """How many of the delimiter characters occur."""
    return F.regexp_count(_col(text), F.lit(f"[{re.escape(delimiters)}]"))


def ends_with(text: str | Column, suffix: str) -> Column:
    return F.endswith(_col(text), F.lit(suffix))


# -- numbers ----------------------------------------------------------------


def ilog2(x: str | Column) -> Column:
    """The whole part of the binary logarithm."""
    return F.length(F.bin(_col(x).cast("long"))) - 1


def is_power_of_two(x: str | Column) -> Column:
    n = _col(x).cast("long")
    return (n > 0) & (n.bitwiseAND(n - 1) == 0)


def abs_diff(a: str | Column, b: str | Column) -> Column:
    return F.abs(_col(a) - _col(b))


def up_log2(x: str | Column) -> Column:
    return F.when(is_power_of_two(x), ilog2(x)).otherwise(ilog2(x) + 1)


def up_pow2(x: str | Column) -> Column:
    return F.pow(F.lit(2), up_log2(x)).cast("long")


def down_pow2(x: str | Column) -> Column:
    return F.pow(F.lit(2), ilog2(x)).cast("long")


def ceil_div(a: str | Column, b: str | Column) -> Column:
    return F.floor((_col(a) + _col(b) - 1) / _col(b)).cast("long")


def chunk_size(k: str | Column, chunks: int, n: str | Column) -> Column:
    """The size of chunk ``k`` of ``n`` things in chunks at most one apart."""
    return (F.floor(_col(n) / chunks) + (_col(k) < _col(n) % chunks).cast("long")).cast("long")


def chunk_start(k: str | Column, chunks: int, n: str | Column) -> Column:
    return (F.floor(_col(n) / chunks) * _col(k) + F.least(_col(k), _col(n) % chunks)).cast("long")


def chunk_of(i: str | Column, chunks: int, n: str | Column) -> Column:
    base, extra = F.floor(_col(n) / chunks), _col(n) % chunks
    big = (base + 1) * extra
    return F.when(_col(i) < big, F.floor(_col(i) / (base + 1))).otherwise(extra + F.floor((_col(i) - big) / F.greatest(base, F.lit(1)))).cast("long")


def bit_reverse(x: str | Column, bits: int) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(_col(x).cast("long")), bits, "0")), 2, 10).cast("long")


# -- vectors ----------------------------------------------------------------


def vector_sum(v: str | Column) -> Column:
    return F.aggregate(_col(v), F.lit(0.0), lambda a, x: a + x)


def vector_scale(v: str | Column, by: float) -> Column:
    return F.transform(_col(v), lambda x: x * by)


def vector_norm2(v: str | Column) -> Column:
    return F.sqrt(F.aggregate(_col(v), F.lit(0.0), lambda a, x: a + x * x))


def vector_dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def vector_axpy(by: float, a: str | Column, b: str | Column) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: by * x + y)


def vector_argmax(v: str | Column) -> Column:
    """The first index of the largest, from 0."""
    return F.array_position(_col(v), F.array_max(_col(v))) - 1


def vector_le(a: str | Column, b: str | Column) -> Column:
    """Every component at most the other's."""
    return F.forall(F.zip_with(_col(a), _col(b), lambda x, y: x <= y), lambda x: x)


def vector_ge(a: str | Column, b: str | Column) -> Column:
    return F.forall(F.zip_with(_col(a), _col(b), lambda x, y: x >= y), lambda x: x)


def vector_max_diff(a: str | Column, b: str | Column) -> Column:
    return F.array_max(F.zip_with(_col(a), _col(b), lambda x, y: x - y))


def differentiate(v: str | Column) -> Column:
    """What each component adds to the one before."""
    return F.transform(_col(v), lambda x, i: x - F.when(i == 0, 0).otherwise(F.get(_col(v), i - 1)))


def prefix_sums(v: str | Column, exclusive: bool = False) -> Column:
    upto = lambda i: F.aggregate(F.slice(_col(v), 1, i if exclusive else i + 1), F.lit(0.0), lambda a, x: a + x)
    return F.transform(_col(v), lambda _, i: upto(i))


def intersection_size(a: str | Column, b: str | Column) -> Column:
    return F.size(F.array_intersect(_col(a), _col(b)))


def merged(a: str | Column, b: str | Column, how: str = "union") -> Column:
    """Sorted distinct components of both arrays (``union``), of both at once (``intersection``), or of the first alone (``difference``)."""
    merge = {"union": F.array_union, "intersection": F.array_intersect, "difference": F.array_except}[how]
    return F.array_sort(merge(_col(a), _col(b)))


def second_argmax(v: str | Column) -> Column:
    """The first index of the second largest, from 0; null for fewer than two components."""
    indexed = F.transform(_col(v), lambda x, i: F.struct((-x).alias("x"), i.alias("i")))
    return F.get(F.array_sort(indexed), 1).getField("i")


def strided_argmax(v: str | Column, stride: int, start: int = 0) -> Column:
    """Of every ``stride``-th component from ``start``: the position, among those, of the first largest."""
    return vector_argmax(F.filter(_col(v), lambda _, i: (i >= start) & ((i - start) % stride == 0)))


def better_balance(a: str | Column, b: str | Column) -> Column:
    """Whether the second vector of excesses is smaller: by the sum of the squares of what is above zero."""
    norm = lambda v: F.aggregate(_col(v), F.lit(0.0), lambda s, x: s + F.when(x > 0, x * x).otherwise(0.0))
    return norm(b) < norm(a)


def better_balance_kway(vwgt: str | Column, ub: str | Column, one: tuple[int, str | Column, str | Column], two: tuple[int, str | Column, str | Column]) -> Column:
    """Whether the second part is nearer its targets once a vertex is added: by the largest excess, then by squares.

    A part is ``(times the vertex counts, its weights, its multipliers)``; the excess of a constraint is the
    multiplier times the new weight, less its bound ``ub``, and the largest excess is 0 at least.
    """

    def excess(times: int, load: str | Column, by: str | Column) -> Column:
        new = F.zip_with(F.zip_with(_col(load), _col(vwgt), lambda p, w: p + times * w), _col(by), lambda p, m: p * m)
        return F.zip_with(new, _col(ub), lambda x, u: x - u)

    largest = lambda e: F.greatest(F.lit(0.0), F.array_max(e))
    square = lambda e: F.aggregate(e, F.lit(0.0), lambda s, x: s + x * x)
    x, y = excess(*one), excess(*two)
    return (largest(y) < largest(x)) | ((largest(y) == largest(x)) & (square(y) < square(x)))
