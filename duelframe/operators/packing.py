"""Rows dealt by a key as bits of a few numbers.

A shuffled row takes eight bytes a column whatever it holds. Here small values are shipped as codes inside 63-bit words and
restored behind the shuffle. A word is used only where it gives back the very same values: otherwise a row ships the values of
that word whole, so every input comes through unchanged, and only the volume depends on what the values are. Words that a
query does not read are pruned with all their checks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

WORD = 63
Known = dict[str, Column]


@dataclass(frozen=True)
class Code:
    """``code`` makes a number of a value, never null; ``wrong`` is not zero where that number would not give the value back."""

    name: str
    bits: int
    code: Callable[[Column, Known], Column]
    wrong: Callable[[Column, Known], Column]
    value: Callable[[Column, Known], Column]
    of: str | None = None


def _kept(number: Column) -> Column:
    """Null is zero, and numbers are odd."""
    return F.coalesce(F.shiftleft(number, 1).bitwiseOR(F.lit(1).cast("long")), F.lit(0).cast("long"))


def _number(name: str, bits: int, number: Callable, value: Callable, exact: Callable | None = None, of: str | None = None) -> Code:
    def wrong(v: Column, known: Known) -> Column:
        n = number(v, known)
        high = F.coalesce(F.shiftright(n, bits), F.lit(0).cast("long"))
        if exact is None:
            return high
        return high.bitwiseOR(F.when(v.isNotNull() & ~F.coalesce(exact(n, known) == v, F.lit(False)), F.lit(1)).otherwise(F.lit(0)).cast("long"))
    back = lambda k, known: F.when(k != 0, value(F.shiftright(k, 1), known))
    return Code(name, bits + 1, lambda v, known: _kept(number(v, known)), wrong, back, of)


def integer(name: str, bits: int) -> Code:
    """Whole numbers from zero on."""
    return _number(name, bits, lambda v, _: v.cast("long"), lambda n, _: n)


def flag(name: str) -> Code:
    return _number(name, 1, lambda v, _: v.cast("int").cast("long"), lambda n, _: n == 1)


def day(name: str) -> Code:
    """Days from 1970 on."""
    return _number(name, 16, lambda v, _: F.unix_date(v).cast("long"), lambda n, _: F.date_from_unix_date(n.cast("int")))


def text(name: str, values: list[str]) -> Code:
    """One of some known texts; the place behind them stands for null."""
    listed, bits = lambda: F.array(*[F.lit(v) for v in values]), len(values).bit_length()
    place = lambda v: F.coalesce(F.array_position(listed(), v), F.lit(len(values) + 1).cast("long")) - 1
    return Code(name, bits, lambda v, _: place(v), lambda v, _: F.shiftright(place(v), bits), lambda k, _: F.get(listed(), k.cast("int")))


def derived(name: str, made: Callable[[Known], Column]) -> Code:
    """A value that follows from columns listed before it."""
    one = lambda c: c.cast("int").cast("long")
    return Code(name, 1, lambda v, _: one(v.isNotNull()), lambda v, known: one(v.isNotNull() & ~v.eqNullSafe(made(known))),
                lambda k, known: F.when(k != 0, made(known)))


def _parts(name: str, bits: int, divisor: Callable[[Known], Column], of: str | None = None) -> Code:
    nearest = lambda v, known: F.floor(v * divisor(known) + F.lit(0.5))
    return _number(name, bits, nearest, lambda n, known: n.cast("double") / divisor(known), lambda n, known: n.cast("double") / divisor(known), of)


def fraction(name: str, parts: int, bits: int) -> Code:
    """Quotients of a whole number by ``parts`` or a divisor of it, such as means of a few whole numbers."""
    return _parts(name, bits, lambda _: F.lit(float(parts)))


def share(name: str, of: str, bits: int) -> Code:
    """Quotients of a whole number by the column ``of``, by one where that is zero."""
    return _parts(name, bits, lambda known: F.greatest(known[of], F.lit(1)).cast("double"), of)


def deal(df: DataFrame, key: str, words: list[list[Code]]) -> DataFrame:
    """``df`` dealt by ``key``; those of its columns that have a code travel in words."""
    if any(sum(c.bits for c in w) > WORD for w in words):
        raise ValueError(f"a word has at most {WORD} bits")
    words = [[c for c in w if c.name in df.columns and (c.of is None or c.of in df.columns)] for w in words]
    words = [w for w in words if w]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    coded = {c.name for w in words for c in w}
    plain = [n for n in df.columns if n not in coded]
    own = {n: F.col(n) for n in df.columns}
    either = lambda parts: parts[0] if len(parts) == 1 else either(parts[:len(parts) // 2]).bitwiseOR(either(parts[len(parts) // 2:]))
    sent = []
    for i, word in enumerate(words):
        bits, at = [], 0
        for c in word:
            bits.append(F.shiftleft(c.code(own[c.name], own), at))
            at += c.bits
        good = either([c.wrong(own[c.name], own) for c in word]) == 0
        sent += [F.when(good, either(bits)).alias(f"_w{i}"), F.when(~good, F.array(F.struct(*[c.name for c in word]))).alias(f"_all{i}")]
    dealt = df.select(*plain, *sent).repartition(key)
    back: Known = {n: F.col(n) for n in plain}
    for i, word in enumerate(words):
        at = 0
        for c in word:
            bits = F.shiftright(F.col(f"_w{i}"), at).bitwiseAND(F.lit((1 << c.bits) - 1).cast("long"))
            # Read by a function, the array keeps the optimizer from shipping its fields one by one.
            whole = F.element_at(f"_all{i}", 1)[c.name]
            back[c.name] = F.when(F.col(f"_w{i}").isNull(), whole).otherwise(c.value(bits, back).cast(kinds[c.name]))
            at += c.bits
    return dealt.select(*[back[n].alias(n) for n in df.columns])
