"""Secret scans: known shapes by regex, unknown ones by windowed entropy, all as Spark expressions.

Method.  Candidate strings are runs of key characters.  Over each candidate a window of
:data:`WINDOW` characters slides; its Shannon entropy follows from character counts that are updated
for the one character that enters and the one that leaves, never recounted.  The highest window
entropy is held against the threshold of the candidate's character class (hexadecimal, or base 64),
and allow-listed shapes are suppressed.

Base kinds, whose spans always stay: ``assign`` (a named secret is assigned), ``access`` and ``hex``.
The method adds ``entropy`` spans that don't overlap a base span.

Defined results.  A null or empty text has no spans.  Rows are scanned one by one; repeated rows and null
ids change nothing.  Further columns pass through, but those named ``base_spans`` or ``all_spans`` give way
to the results.  Positions are code points, ends exclusive.  Time grows with a text's length, not its square.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from grapnel.llm.text import before, let, running

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")
MIN_VALUE = 12

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Least bits a character in the best window, by class of the whole candidate.
LEAST_BITS = {"hex": 3.0, "base64": 3.6}
#: Candidates that contain one of these are not secrets: placeholders, runs of the alphabet, nothing but letters, digits or signs.
ALLOWED = (r"(?i)example|placeholder|your[_-]?(api)?[_-]?key|x{6,}", r"(?i)abcdefgh|0123456789|qwerty", r"^[A-Za-z]+$", r"^[0-9]+$", r"^[_=+/-]+$")


_SPANS = "array<struct<s:int,e:int,k:int,v:string>>"


def _placed(text: Column, pattern: str, kind: str) -> Column:
    """Array of (s, e, k, v) of the pattern's matches; positions are running sums of the lengths around them."""
    k = KINDS.index(kind)

    def spans(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern), lambda p: F.length(p))
        sizes = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("g"), (g + F.length(m)).alias("n")))
        at = lambda z: F.zip_with(z, before(F.transform(z, lambda x: x["n"])), lambda x, p: (p + x["g"]).cast("int"))
        return F.zip_with(let(sizes, at), found, lambda s, m: F.struct(s.alias("s"), (s + F.length(m)).alias("e"), F.lit(k).alias("k"), m.alias("v")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def window_bits(candidate: Column, width: int = WINDOW) -> Column:
    """The highest Shannon entropy (bits a character) of any window of ``width`` (at most 31) ASCII characters.

    Counts take five bits each, twelve to a long, so a step adds to one packed counter and takes from
    another; the sum of c*log2(c) follows by two terms.
    """
    if not 1 <= width <= 31:
        raise ValueError("a count has five bits: windows of 1 to 31 characters")
    terms = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(width + 2)))
    term = lambda c: F.get(terms, c.cast("int"))
    place = lambda code: F.struct(F.floor(code / 12).cast("int").alias("word"), (F.pmod(code, F.lit(12)) * 5).alias("shift"))
    unit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at["shift"])
    count = lambda packed, at: F.call_function("shiftright", F.get(packed, at["word"]), at["shift"]).bitwiseAND(F.lit(31).cast("long"))

    def slide(places: Column) -> Column:
        def enter(acc: Column, at: Column) -> Column:
            n = count(acc["c"], at)
            return F.struct(F.transform(acc["c"], lambda v, i: F.when(i == at["word"], v + unit(at)).otherwise(v)).alias("c"), (acc["t"] - term(n) + term(n + 1)).alias("t"))

        def step(acc: Column, move: Column) -> Column:
            new, old = move["new"], move["old"]
            cn, co = count(acc["c"], new), count(acc["c"], old)
            moved = acc["t"] - term(cn) - term(co) + term(cn + 1) + term(co - 1)
            counts = F.transform(acc["c"], lambda v, i: v + F.when(i == new["word"], unit(new)).otherwise(0) - F.when(i == old["word"], unit(old)).otherwise(0))
            return F.when(new == old, acc).otherwise(F.struct(counts.alias("c"), moved.alias("t"), F.least(acc["low"], moved).alias("low")))

        empty = F.struct(F.array_repeat(F.lit(0).cast("long"), F.lit(11)).alias("c"), F.lit(0.0).alias("t"))
        start = let(F.aggregate(F.slice(places, 1, width), empty, enter), lambda a: F.struct(a["c"].alias("c"), a["t"].alias("t"), a["t"].alias("low")))
        more = F.greatest(F.size(places) - width, F.lit(0))
        moves = F.zip_with(F.slice(places, width + 1, more), F.slice(places, 1, more), lambda n, o: F.struct(n.alias("new"), o.alias("old")))
        # H = log2(w) - sum(c log2 c) / w: the highest entropy has the lowest sum
        return F.log2(F.lit(float(width))) - F.aggregate(moves, start, step)["low"] / width

    return let(F.transform(F.split(candidate, ""), lambda ch: place(F.ascii(ch))), slide)


def is_secret(candidate: Column) -> Column:
    """Of a candidate of :data:`WINDOW` characters or more.

    No key starts with ``=``, so leading ones are not scored; other signs can start one and are, except
    before hexadecimal digits.
    """
    rest, bare = (F.regexp_replace(candidate, p, "") for p in ("^=+", "^[_=+/-]+"))
    is_hex = bare.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") & (F.length(bare) >= WINDOW)
    return _scores(F.when(is_hex, bare).otherwise(rest), is_hex)


def _scores(candidate: Column, is_hex: Column) -> Column:
    allowed = F.length(candidate) < WINDOW
    for p in ALLOWED:
        allowed = allowed | candidate.rlike(p)
    least = F.when(is_hex, F.lit(LEAST_BITS["hex"])).otherwise(F.lit(LEAST_BITS["base64"]))
    return F.when(allowed | ~candidate.rlike("[0-9]") | ~candidate.rlike("[A-Za-z]"), F.lit(False)).otherwise(window_bits(candidate) >= least)


def _in_order(spans: Column) -> Column:
    """By start, then kind."""
    keyed = F.sort_array(F.transform(spans, lambda x: F.struct(x["s"], x["k"], x["e"], x["v"])))
    return F.transform(keyed, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), x["v"].alias("v")))


def _free(candidates: Column, spans: Column) -> Column:
    """The candidates that overlap none of the spans.

    In the order of starts, with the spans first among equals, a candidate overlaps an earlier span just
    if the furthest end so far lies beyond its start, and a later one if the next start lies before its end.
    """
    tagged = F.concat(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(0).alias("own"), x.alias("x"))), F.transform(candidates, lambda x: F.struct(x["s"].alias("s"), F.lit(1).alias("own"), x.alias("x"))))
    is_span = lambda r: r["own"] == 0

    def told(rows: Column) -> Column:
        ends = running(F.transform(rows, lambda r: F.when(is_span(r), r["x"]["e"]).otherwise(F.lit(-1))), F.lit(-1), F.greatest)
        starts = F.reverse(running(F.transform(F.reverse(rows), lambda r: F.when(is_span(r), r["s"]).otherwise(F.lit(2**31 - 1))), F.lit(2**31 - 1), F.least))
        both = F.zip_with(rows, F.arrays_zip(ends.alias("end"), starts.alias("next")), lambda r, n: F.struct(r["own"].alias("own"), ((n["end"] <= r["s"]) & (n["next"] >= r["x"]["e"])).alias("free"), r["x"].alias("x")))
        return F.transform(F.filter(both, lambda r: (r["own"] == 1) & r["free"]), lambda r: r["x"])

    return F.when((F.size(candidates) == 0) | (F.size(spans) == 0), candidates).otherwise(let(F.sort_array(tagged), told))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``all_spans``: arrays of (s, e, k, v), sorted by start, then kind;
    ``k`` counts :data:`KINDS` from 0 and ``v`` is the text found."""
    value = F.coalesce(F.col(text), F.lit(""))
    none = F.expr(f"CAST(array() AS {_SPANS})")
    group2 = F.regexp_extract_all(value, F.lit(ASSIGN), F.lit(2))
    assigned = let(group2, lambda g: F.filter(_placed(value, ASSIGN, "assign"), lambda x, i: F.length(F.get(g, i)) >= MIN_VALUE))
    found = docs.withColumns(
        {
            "__assign": F.when((F.contains(value, F.lit("=")) | F.contains(value, F.lit(":"))) & value.rlike(ASSIGN), assigned).otherwise(none),
            "__access": F.when(F.contains(value, F.lit("AKIA")), _placed(value, ACCESS, "access")).otherwise(none),
            "__hex": F.when(value.rlike(HEX), _placed(value, HEX, "hex")).otherwise(none),
            "__cand": F.when(value.rlike(CANDIDATE), _placed(value, CANDIDATE, "entropy")).otherwise(none),
        }
    ).withColumn("base_spans", _in_order(F.concat("__assign", "__access", "__hex")))
    added = F.filter(_free(F.col("__cand"), F.col("base_spans")), lambda c: is_secret(c["v"]))
    return found.withColumn("all_spans", _in_order(F.concat("base_spans", added))).drop("__assign", "__access", "__hex", "__cand")


def digest(spans: str) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
