"""Scalar expressions that the workloads share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nth_field(line: Column, n: int, sep: str = ",") -> Column:
    """Field n from 0 of a line, null beyond the last."""
    return F.get(F.split(line, sep), F.lit(n))


def parse_double(text: Column) -> Column:
    """Null where the text is no number, so that a comparison isn't met."""
    return text.try_cast("double")


def tokens(text: Column) -> Column:
    """ASCII letter and digit runs, case kept."""
    return F.regexp_extract_all(text, F.lit("([A-Za-z0-9]+)"), F.lit(1))


def count_char(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def count_class(text: Column, char_class: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, char_class, ""))


def ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    """scale * a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(scale * a / F.nullif(b, F.lit(0)))


def floor_div(a: Column, b: Column) -> Column:
    """Integer division rounding down, which ``div`` doesn't do for negative numbers; decimals keep it exact."""
    return F.floor(a.cast("decimal(19,0)") / b.cast("decimal(19,0)")).cast("bigint")


def gray(r: Column, g: Column, b: Column) -> Column:
    """Weighted mean of the channels in integers: (77 r + 150 g + 29 b) >> 8."""
    return F.shiftright(77 * r + 150 * g + 29 * b, 8)


def saturating_add(v: Column, n: int) -> Column:
    return F.least(F.lit(255), v + n)


def low_bits(v: Column, bits: int) -> Column:
    return v.bitwiseAND(F.lit((1 << bits) - 1))


def thousands(v: Column) -> Column:
    return F.format_number(v, 0)


def gcd(a: Column, b: Column, steps: int = 48) -> Column:
    """Euclid's algorithm as a fold over a fixed number of steps; 48 suffice below 2**32."""
    start = F.struct(F.greatest(a, b).cast("bigint").alias("x"), F.least(a, b).cast("bigint").alias("y"))
    step = lambda s, _: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, s["y"]).otherwise(s["x"] % F.nullif(s["y"], F.lit(0))).alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["x"])


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all other characters kept."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _low_product(a: Column, m: int) -> Column:
    """a * m modulo 2**32, for a of at most 32 bits."""
    m &= (1 << 32) - 1
    high = F.shiftleft((a * F.lit(m >> 16).cast("bigint")).bitwiseAND(F.lit(0xFFFF)), 16)
    return (a * F.lit(m & 0xFFFF).cast("bigint") + high).bitwiseAND(F.lit(0xFFFFFFFF))


def wrapping_mul(a: Column, m: int) -> Column:
    """a * m modulo 2**64 as the bits of a bigint; nothing overflows on the way, so ANSI mode doesn't raise."""
    m &= (1 << 64) - 1
    low, high = a.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(a, 32)
    t0, t1 = low * F.lit(m & 0xFFFF).cast("bigint"), low * F.lit(m >> 16 & 0xFFFF).cast("bigint")
    bottom = t0.bitwiseAND(F.lit(0xFFFFFFFF)) + F.shiftleft(t1.bitwiseAND(F.lit(0xFFFF)), 16)
    top = F.shiftrightunsigned(t0, 32) + F.shiftrightunsigned(t1, 16) + F.shiftrightunsigned(bottom, 32) + _low_product(low, m >> 32) + _low_product(high, m)
    return F.shiftleft(top, 32).bitwiseOR(bottom.bitwiseAND(F.lit(0xFFFFFFFF)))


def unsigned_mod(bits: Column, m: int) -> Column:
    """The remainder of a bigint's bits read as an unsigned number."""
    return F.pmod(F.pmod(bits, F.lit(m).cast("bigint")) + F.when(bits < 0, F.lit((1 << 64) % m).cast("bigint")).otherwise(F.lit(0).cast("bigint")), F.lit(m).cast("bigint"))
