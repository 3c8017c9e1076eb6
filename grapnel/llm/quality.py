"""Quality rules as a bitmask ledger.

Every rule is evaluated once a document.  The ledger stores what was measured and one failure bit a
rule.  Policies are versioned bit masks, applied later with one bitwise AND, and ablations (what
would a policy keep without this rule?) are sums over the same bits.  Nothing is shuffled to make
the ledger; an ablation is one aggregate row a policy.

Defined results.  A null text has no words and no lines with words; rows are measured one by one, so
null ids and repeated rows change nothing.  Further columns pass through, but those that have the name of
one of the ledger's columns: the ledger's take their place.  Repeated windows of words are found by
their 64-bit hash inside one document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from grapnel.llm.text import BLANK_RUN, BLANKS, let, pieces, without

SYMBOLS = "#*$%&|<>"
WINDOW = 3

#: Rule names in bit order, each with its test over the measurements.  A name never changes its bit.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("many_words", "n_words > 1000000"),
    ("odd_word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "n_dup_lines > 3 AND 10 * n_dup_lines > 3 * n_lines"),  # one echo in a short text is no fault
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A named, versioned set of rules; a document passes if it fails none of them."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
DEFAULT = Policy("default", 2, ("few_words", "repeated_windows", "odd_word_length", "symbols", "repeated_lines"))
POLICIES = (BASE, DEFAULT)


def _repeat_words(words: Column) -> Column:
    """Words that stand in windows found twice or more."""
    hashes = F.transform(F.slice(words, 1, F.size(words) - (WINDOW - 1)), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def marked(ordered: Column) -> Column:
        twins = F.filter(ordered, lambda e, i: F.coalesce(e["h"] == F.get(ordered, i - 1)["h"], F.lit(False)) | F.coalesce(e["h"] == F.get(ordered, i + 1)["h"], F.lit(False)))
        return F.size(F.array_distinct(F.flatten(F.transform(twins, lambda e: F.array(e["p"], e["p"] + 1, e["p"] + 2)))))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ordered, marked))

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(hashes, covered))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words`` (long) and
    ``fail_bits`` (long, one bit a rule of :data:`RULES`)."""
    value = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(value, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    words = let(pieces(value, BLANK_RUN), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r")))
    told = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    measured = docs.withColumns({"__w": words, "__l": told}).withColumns(
        {
            "n_words": F.col("__w.n").cast("long"),
            "word_chars": F.length(without(value, BLANKS)).cast("long"),
            "n_symbols": (F.length(value) - F.length(without(value, SYMBOLS))).cast("long"),
            "n_lines": F.col("__l.n").cast("long"),
            "n_dup_lines": F.col("__l.d").cast("long"),
            "n_repeat_words": F.col("__w.r").cast("long"),
        }
    )
    bits = sum((F.when(F.expr(test), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long") for name, test in RULES), F.lit(0).cast("long"))
    return measured.withColumn("fail_bits", bits).drop("__w", "__l")


def passes(policy: Policy, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablations(book: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """A row for each policy and rule in it: documents kept, failing the rule, and lost to this rule
    alone (what dropping the rule from the policy would bring back).  One aggregation, a row a task."""
    counts, rows = [F.count("*").alias("n")], []
    for p in policies:
        counts.append(F.count_if(passes(p)).alias(f"k_{p.name}_{p.version}"))
        for r in p.rules:
            held = F.col("fail_bits").bitwiseAND(F.lit(p.mask).cast("long"))
            counts.append(F.count_if(held == BIT[r]).alias(f"a_{p.name}_{p.version}_{r}"))
            counts.append(F.count_if(held.bitwiseAND(F.lit(BIT[r]).cast("long")) != 0).alias(f"f_{p.name}_{p.version}_{r}"))
            rows.append(F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(r).alias("rule"), F.col("n").alias("n_docs"), F.col(f"k_{p.name}_{p.version}").alias("n_kept"), F.col(f"f_{p.name}_{p.version}_{r}").alias("n_failed"), F.col(f"a_{p.name}_{p.version}_{r}").alias("n_only_this")))
    return book.agg(*counts).select(F.inline(F.array(*rows)))
