"""Tokens of rings wider than 64 bits: two limbs, since a decimal ends at 38 digits. Built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ring of 128 bits: its tokens are whole numbers from -2**127 to 2**127 - 1.
WIDE_MIN, WIDE_MAX = -(1 << 127), (1 << 127) - 1
WIDE = "struct<hi:bigint,lo:decimal(20,0)>"
_BIG = "decimal(38,0)"
_HALF, _LIMB, _TEN = 1 << 32, 1 << 64, 10**19


def _n(value: int) -> Column:
    return F.lit(str(value)).cast(_BIG)


def _parts(a: Column, by: int) -> tuple[Column, Column]:
    """Quotient and remainder of a non-negative whole number."""
    rest = (a % _n(by)).cast(_BIG)
    return ((a - rest) / _n(by)).cast(_BIG), rest


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def wide_token(text: Column) -> Column:
    """A token's decimal digits as struct(hi, lo): hi * 2**64 + lo, lo from 0 to 2**64 - 1, so structs sort as the numbers do. Text
    that is no whole number of the 128-bit ring is null."""

    def limbs(x: Column) -> Column:
        high, low = F.substring(x["digits"], 1, 20).cast(_BIG), F.substring(x["digits"], 21, 19).cast(_BIG)
        a1, a0 = _parts(high, _HALF)
        return F.struct(x["minus"].alias("minus"), (a1 * _n(_TEN)).cast(_BIG).alias("p"), (a0 * _n(_TEN) + low).cast(_BIG).alias("q"))

    def joined(x: Column) -> Column:
        up, rest = _parts(x["p"], _HALF)
        carry, lo = _parts((rest * _n(_HALF) + x["q"]).cast(_BIG), _LIMB)
        return F.struct(x["minus"].alias("minus"), (up + carry).cast(_BIG).alias("hi"), lo.alias("lo"))

    def signed(x: Column) -> Column:
        whole = x["lo"] == 0
        hi = F.when(~x["minus"], x["hi"]).when(whole, -x["hi"]).otherwise(-x["hi"] - 1).cast(_BIG)
        lo = F.when(x["minus"] & ~whole, _n(_LIMB) - x["lo"]).otherwise(x["lo"])
        return F.when((hi >= _n(-(1 << 63))) & (hi < _n(1 << 63)), F.struct(hi.try_cast("bigint").alias("hi"), lo.cast("decimal(20,0)").alias("lo")))

    t = F.trim(text.cast("string"))
    digits = F.struct(t.startswith("-").alias("minus"), F.lpad(F.regexp_replace(t, "^[+-]?0*", ""), 39, "0").alias("digits"))
    return F.when(t.rlike(r"^[+-]?0*[0-9]{1,39}$"), _bound(_bound(_bound(digits, limbs), joined), signed))


def wide_order(text: Column) -> Column:
    """A token's decimal digits as struct(hi, mid, lo) of whole numbers that sorts as the tokens do: the first 19, next 10 and last 10 of
    39 digits, each with the token's sign. Text that is no whole number of the 128-bit ring is null. Where tokens are only
    compared this is enough, and much cheaper than limbs of 64 bits: no decimals, no lambdas."""
    t = F.trim(text.cast("string"))
    digits = F.lpad(F.regexp_replace(t, "^[+-]?0*", ""), 39, "0")
    sign = F.when(t.startswith("-"), F.lit(-1)).otherwise(F.lit(1)).cast("long")
    limbs = F.struct(*[(F.substring(digits, at, n).cast("long") * sign).alias(name) for name, at, n in (("hi", 1, 19), ("mid", 20, 10), ("lo", 30, 10))])
    # of 39 digits, which text of this form has, order is that of numbers
    least, most = (F.lit(str(abs(v))) for v in (WIDE_MIN, WIDE_MAX))
    return F.when(t.rlike(r"^[+-]?0*[0-9]{1,39}$") & (digits <= F.when(t.startswith("-"), least).otherwise(most)), limbs)


def wide_slots(start: Column, end: Column) -> Column:
    """Tokens in the range (start, end] of two wide tokens, as struct(hi, lo) without a sign. A range that wraps counts as
    token_slots counts it; equal ends are 2**127 - 1, the largest token."""

    def borrowed(x: Column) -> Column:
        less = x["lo"] < 0
        return F.struct((x["hi"] - F.when(less, _n(1)).otherwise(_n(0))).cast(_BIG).alias("hi"), (x["lo"] + F.when(less, _n(_LIMB)).otherwise(_n(0))).cast(_BIG).alias("lo"))

    def wrapped(x: Column) -> Column:
        none = x["lo"] == 0
        around = F.struct((x["hi"] + _n(_LIMB) - F.when(none, _n(1)).otherwise(_n(0))).cast(_BIG).alias("hi"), F.when(none, _n(_LIMB - 1)).otherwise(x["lo"] - 1).cast(_BIG).alias("lo"))
        return F.when(x["hi"] < 0, around).otherwise(x)

    big = lambda c: c.cast(_BIG)
    apart = F.struct((big(end["hi"]) - big(start["hi"])).cast(_BIG).alias("hi"), (big(end["lo"]) - big(start["lo"])).cast(_BIG).alias("lo"))
    whole = F.struct(_n((1 << 63) - 1).alias("hi"), _n(_LIMB - 1).alias("lo"))
    return F.when(start == end, whole).when(start.isNotNull() & end.isNotNull(), _bound(_bound(apart, borrowed), wrapped))


def wide_text(number: Column) -> Column:
    """A struct(hi, lo) as decimal digits, with a minus where hi is negative."""

    def halves(x: Column) -> Column:
        minus, whole = x["hi"] < 0, x["lo"] == 0
        hi = F.when(~minus, x["hi"].cast(_BIG)).when(whole, -x["hi"].cast(_BIG)).otherwise(-x["hi"].cast(_BIG) - 1).cast(_BIG)
        lo = F.when(minus & ~whole, _n(_LIMB) - x["lo"]).otherwise(x["lo"].cast(_BIG)).cast(_BIG)
        (h1, h0), (l1, l0) = _parts(hi, _HALF), _parts(lo, _HALF)
        return F.struct(minus.alias("minus"), _n(0).alias("x"), h1.alias("y"), F.array(h0, l1, l0).alias("next"))

    def step(k: int) -> Callable[[Column], Column]:
        def run(x: Column) -> Column:
            up, y = _parts((x["y"] * _n(_HALF) + x["next"][k]).cast(_BIG), _TEN)
            return F.struct(x["minus"].alias("minus"), (x["x"] * _n(_HALF) + up).cast(_BIG).alias("x"), y.alias("y"), x["next"].alias("next"))

        return run

    out = _bound(number, halves)
    for k in range(3):
        out = _bound(out, step(k))
    digits = lambda x: F.regexp_replace(F.concat(x["x"].cast("string"), F.lpad(x["y"].cast("string"), 19, "0")), "^0+(?=[0-9])", "")
    return F.when(number.isNotNull(), _bound(out, lambda x: F.concat(F.when(x["minus"], "-").otherwise(""), digits(x))))
