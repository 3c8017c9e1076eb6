"""License scans: fuzzy search for short notices over normalised words.

Method.  A notice of m characters that may have k edits is cut into k + 1 pieces; whichever way k edits
fall, one piece stays exact (pigeonhole).  Exact searches for the pieces locate candidates: the runs of
whole words that begin and end within k characters of where the piece puts them.  The regex library
matches each with at most k errors, which gives the least edits.  Exact base phrases are searched as they are.
An edit is a character; words are joined by one blank.

Defined results.  A null text is empty: no words, no labels, score 0.  Documents are scanned one by one
and whole, so null ids, repeated rows and further columns change nothing.  Spans count words from 0,
end exclusive; of spans of one notice that share a word the one with fewest edits stays, then the earlier,
then the shorter.  The score is the best match's share of unedited characters.  Time grows with a text's
length, not its square.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from grapnel.llm.batches import map_texts

#: Exact phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Short notices that are searched with errors: phrase, label, most edits.
NOTICES = (
    ("released under the mit license", "mit", 3),
    ("licensed under the apache license version 2", "apache-2", 4),
    ("gnu general public license", "gpl", 2),
    ("gnu lesser general public license", "lgpl", 2),
    ("gnu affero general public license", "agpl", 2),
    ("mozilla public license", "mpl", 2),
    ("licensed under cc by nc", "cc-by-nc", 1),
    ("creative commons attribution", "cc-by", 2),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("permission is hereby granted free of charge", "mit", 4),
    ("all rights reserved", "all-rights-reserved", 1),
)
#: A-Z to a-z; ASCII that is neither letter nor digit to blank; all else as it is.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_BLANK = re.compile(" ")

SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("edits", T.IntegerType())])
SCHEMA = [
    ("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()),
    ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType()), ("spans", T.ArrayType(SPAN)),
]


def seeds(phrase: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece): the phrase in ``edits + 1`` pieces of nearly one length."""
    parts, n = edits + 1, len(phrase)
    cuts = [n * i // parts for i in range(parts + 1)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:])]


def _places(text: str, what: str):
    at = text.find(what)
    while at >= 0:
        yield at
        at = text.find(what, at + 1)


def best_apart(found: dict[tuple[int, int], int]) -> list[tuple[int, int, int]]:
    """(start, end, edits) of spans that share no word: those with fewer edits first, then the earlier, then the shorter."""
    taken, out = set(), []
    for edits, start, end in sorted((n, a, b) for (a, b), n in found.items()):
        if taken.isdisjoint(range(start, end)):
            taken.update(range(start, end))
            out.append((start, end, edits))
    return sorted(out)


def scanner(base=BASE, notices=NOTICES) -> Callable[[], Callable]:
    def make() -> Callable:
        import regex

        exact = [(f" {phrase} ", label) for phrase, label in base]
        fuzzy = [(phrase, label, k, seeds(phrase, k), regex.compile(rf"(?:{regex.escape(phrase, literal_spaces=True)}){{e<={k}}}", regex.BESTMATCH)) for phrase, label, k in notices]

        def matches(line: str, blanks: list[int], phrase: str, k: int, parts, pattern) -> dict[tuple[int, int], int]:
            """Edits of every run of whole words within ``k`` edits of the phrase, by (first word, end)."""
            found, tried = {}, set()
            for offset, piece in parts:
                for at in _places(line, piece):
                    # edits before the piece move the start by at most k, those after it the end
                    begin, stop = at - offset, at - offset + len(phrase)
                    for i in range(bisect_left(blanks, begin - k - 1), bisect_right(blanks, begin + k - 1)):
                        for j in range(max(i + 1, bisect_left(blanks, stop - k)), bisect_right(blanks, stop + k)):
                            if (i, j) not in tried and abs(blanks[j] - blanks[i] - 1 - len(phrase)) <= k:
                                tried.add((i, j))
                                if m := pattern.fullmatch(line, blanks[i] + 1, blanks[j]):
                                    found[i, j] = sum(m.fuzzy_counts)
            return found

        def scan(text: bytes) -> list[tuple]:
            words = text.translate(_NORMAL).split()
            line = (b" %b " % b" ".join(words)).decode("utf-8", "replace")
            blanks: list[int] = []
            places, base_labels, labels, spans, score = [], set(), set(), [], 0.0
            for what, label in exact:
                for at in _places(line, what):
                    blanks = blanks or [m.start() for m in _BLANK.finditer(line)]
                    places.append(bisect_left(blanks, at))
                    base_labels.add(label)
                    score = 1.0
            for phrase, label, k, parts, pattern in fuzzy:
                if not any(piece in line for _, piece in parts):
                    continue
                blanks = blanks or [m.start() for m in _BLANK.finditer(line)]
                for start, end, edits in best_apart(matches(line, blanks, phrase, k, parts, pattern)):
                    labels.add(label)
                    spans.append((label, start, end, edits))
                    score = max(score, 1.0 - edits / len(phrase))
            row = (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels | base_labels)), score)
            return [(*row, [dict(zip(("label", "start", "end", "edits"), s)) for s in sorted(spans, key=lambda s: (s[1], s[2], s[0]))])]

        return scan

    return make


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", base=BASE, notices=NOTICES) -> DataFrame:
    """A row for each document: the id and the columns of :data:`SCHEMA`; ``spans`` has every fuzzy match."""
    return map_texts(docs, doc_id, text, scanner(base, notices), SCHEMA)


def digest(spans: str) -> Column:
    """``label:start:end:edits``, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["label"], x["start"].cast("string"), x["end"].cast("string"), x["edits"].cast("string"))), ",")
