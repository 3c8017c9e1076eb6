"""Native text expressions that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The characters of ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
#: What stands between words once A-Z are lower-cased: ASCII that is neither digit nor small letter.
NON_WORD_RUN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once however often the body (or a lambda in it) uses it.

    The optimizer may copy a projected expression into a lambda, where it would run once an element;
    a lambda variable can't be copied.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else.  Pure ASCII takes the vectorized path; other texts are translated."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def pieces(text: Column, separator: str) -> Column:
    """What the separators leave, empty pieces dropped.  Only the first and last can be empty."""
    return F.filter(F.split(text, separator), lambda w: w != "")


def without(text: Column, characters: str) -> Column:
    """The text without these characters: a chain of byte searches, far cheaper than a regex."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def rows_again(n: str) -> Column:
    """A generator of as many rows as column ``n`` says: repeated input rows come back."""
    return F.explode(F.array_repeat(F.lit(1), F.col(n).cast("int")))


#: Elements that :func:`running` takes at a time.
BLOCK = 256


def running(values: Column, zero: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each element what ``add`` makes of all elements before it, from ``zero``; ``add`` is associative.

    A fold that appends to an array copies it at every step.  Here blocks of :data:`BLOCK` elements are
    folded one by one and then lifted by what came before them, so long arrays stay cheap.
    """

    def scan(xs: Column) -> Column:
        none = F.slice(F.array(zero), 1, 0)
        return F.aggregate(xs, F.struct(zero.alias("at"), none.alias("out")), lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def lifted(vs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(vs), F.lit(1)), F.lit(BLOCK)), lambda i: scan(F.slice(vs, i, BLOCK)))
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, scan(F.transform(bs, lambda b: b["at"]))["out"], lambda b, base: F.transform(b["out"], lambda x: add(base, x)))))

    return let(values, lifted)


def before(lengths: Column) -> Column:
    """The sum of all elements before each (long)."""
    return running(F.transform(lengths, lambda x: x.cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
