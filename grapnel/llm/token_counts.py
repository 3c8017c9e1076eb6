"""Token counts by prefix dynamic programming.

Method.  A sequence of tokens is what byte-pair merging gives just when each neighbouring pair in it
is (a pair of tokens that merging would have joined otherwise can't stand in a result).  So the
encoding of a prefix is the encoding of a shorter prefix plus one last token that agrees with that
prefix's last token, and there is exactly one such token.  One pass over a piece's bytes finds the last
token and the count at every prefix; pair checks are remembered.

A text falls into chunks (blanks, then what follows up to the next blank).  No token spans two chunks,
so counts at all prefixes are the chunks' counts plus a running sum.  Budget and truncation questions
are answered from these counts, without encoding anything again.

The vocabulary's special strings cut a text first and are one token each; a text with blanks outside
ASCII is cut into chunks at these too.  Which characters are blanks is asked of the library once a
process.  A prefix that ends inside a special string is plain text there.  No text goes to the library whole.

Defined results.  A null text is empty and has 0 tokens.  Rows are counted one by one; null ids, repeated
rows and further columns change nothing.  A prefix that ends inside a character has no count.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, types as T

from grapnel.llm.batches import map_texts, segments

LIMIT = 1024
CACHE_CHUNKS = 300_000
VOCABULARY = "byte_bpe_50k.json"
_CHUNK = re.compile(rb"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+\Z")
#: Characters that some libraries count as blanks; the vocabulary's own library tells which are.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
#: Chunks whose pieces are cut here: one blank at most, then ASCII and Latin letters.
_LATIN = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_PLAIN = re.compile(f"[ \n]?[!-~{_LATIN}]+")
#: Pieces of more bytes than this keep their prefixes out of the table.
LONG_PIECE = 512
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^ \\n0-9{_LATIN}]+|\\n")


def default_vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies spell bytes as printable characters: printable Latin-1 stands for itself,
    every other byte for the next code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter(dict):
    """Chunk (bytes) to the token count of the whole chunk; :meth:`prefixes` has all of them."""

    def __init__(self, path: str, limit: int = CACHE_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder, self.limit = Tokenizer.from_file(path), limit
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        letters = byte_letters()
        spell = lambda s: bytes(map(letters.__getitem__, s))
        if any(t[flag] for t in told["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("special strings that take blanks, need word borders or are normalized")
        special = sorted({t["content"] for t in told["added_tokens"]}, key=len, reverse=True)
        self.special = [s.encode() for s in special]
        self.special_strings = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        blanks = "".join(chr(c) for c in range(0x10000) if _ODD.match(chr(c)) and self.is_blank(chr(c)))
        self.odd = re.compile(f"[{blanks}]") if blanks else None
        self.chunk = re.compile(f"[ \\t\\n\\r\\x0b\\x0c{blanks}]*[^ \\t\\n\\r\\x0b\\x0c{blanks}]+|[ \\t\\n\\r\\x0b\\x0c{blanks}]+\\Z")
        self.blank_run = re.compile(f"[ \\t\\n\\r\\x0b\\x0c{blanks}]*")
        merges = (m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"])
        self.rank = {(spell(a), spell(b)): i for i, (a, b) in enumerate(merges)}
        #: How each token is made: (rank of its merge, left part, right part); single bytes come first.
        self.made = {a + b: (i, a, b) for (a, b), i in reversed(self.rank.items())}
        for b in range(256):
            self.made[bytes([b])] = (-1, b"", b"")
        self.longest = max(map(len, self.made))
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.table: dict[bytes, tuple[bytes, int]] = {b"": (b"", 0)}
        self.old: dict[bytes, int] = {}

    def is_blank(self, c: str) -> bool:
        """Whether the library's pre-tokenizer takes it for a blank: it joins neither letters, digits nor signs."""
        return all(len(self.encoder.pre_tokenizer.pre_tokenize_str(x + c + x)) > 1 for x in "a1!")

    def agree(self, a: bytes, b: bytes) -> bool:
        """Whether the two tokens can stand side by side in a result of merging.

        Their merges are undone from the last to the first.  Before each, the two parts at the border
        were neighbours, so a merge of these parts of an earlier rank (or, as merging goes from left
        to right, of the right token's own rank) would have been made instead.
        """
        rank, made, limit = self.rank, self.made, 1 << 30
        while True:
            m = rank.get((a, b))
            if m is not None and m < limit:
                return False
            (ra, _, right), (rb, left, _) = made[a], made[b]
            if ra > rb:
                a, limit = right, ra
            elif rb >= 0:
                b, limit = left, rb + 1
            else:
                return True

    def reach(self, piece: bytes) -> tuple[bytes, int]:
        """(last token, token count) of a piece that merging treats as one.

        The table holds every prefix of what was seen, so a piece goes on from its longest known prefix.
        """
        table = self.table
        found = table.get(piece)
        if found is not None:
            return found
        if len(table) >= self.limit:
            table.clear()
            table[b""] = (b"", 0)
        tokens, n = self.made, len(piece)
        known = n - 1
        while piece[:known] not in table:
            known -= 1
        last = table[piece[:known]][0]
        for end in range(known + 1, n + 1):
            # one token fits and no other: the last one with a byte more is tried first, then all from the longest
            longer = end - 1 - len(last)
            t = piece[longer:end]
            if not (t in tokens and (not longer or self.fits(table[piece[:longer]][0], t))):
                for start in range(max(0, end - self.longest), end):
                    t = piece[start:end]
                    if t in tokens and start != longer and (not start or self.fits(table[piece[:start]][0], t)):
                        break
            found = table[piece[:end]] = (t, table[piece[: end - len(t)]][1] + 1)
            last = t
        return found

    def walk(self, piece: bytes) -> list[int]:
        """Token counts at every byte prefix of a long piece: the same pass over lists of its own."""
        tokens, lasts, counts = self.made, [b""], [0]
        for end in range(1, len(piece) + 1):
            longer = end - 1 - len(lasts[-1])
            t = piece[longer:end]
            if not (t in tokens and (not longer or self.fits(lasts[longer], t))):
                for start in range(max(0, end - self.longest), end):
                    t = piece[start:end]
                    if t in tokens and start != longer and (not start or self.fits(lasts[start], t)):
                        break
            lasts.append(t)
            counts.append(counts[end - len(t)] + 1)
        return counts

    def fits(self, left: bytes, token: bytes) -> bool:
        pair = (left, token)
        ok = self.pairs.get(pair)
        if ok is None:
            if len(self.pairs) >= self.limit:
                self.pairs.clear()
            ok = self.pairs[pair] = self.agree(left, token)
        return ok

    def piece(self, piece: bytes) -> list[int]:
        """Token counts at every byte prefix."""
        if len(piece) > LONG_PIECE:
            return self.walk(piece)
        self.reach(piece)
        return [self.table[piece[:i]][1] for i in range(len(piece) + 1)]

    def piece_total(self, piece: bytes) -> int:
        return self.walk(piece)[-1] if len(piece) > LONG_PIECE else self.reach(piece)[1]

    def pieces(self, chunk: str) -> list[str]:
        """The pieces that merging treats one by one."""
        if _PLAIN.fullmatch(chunk):
            return _PIECES.findall(chunk)
        return [chunk[a:b] for _, (a, b) in self.encoder.pre_tokenizer.pre_tokenize_str(chunk)]

    def total(self, chunk: bytes) -> int:
        return sum(self.piece_total(p.encode()) for p in self.pieces(chunk.decode()))

    def char_counts(self, piece: str) -> list[int]:
        """Token counts of a piece at every code point from 0."""
        counts, at, out = self.piece(piece.encode()), 0, [0]
        for c in piece:
            at += len(c.encode())
            out.append(counts[at])
        return out

    def prefixes(self, chunk: str) -> list[int]:
        """Exact counts of ``chunk[:i]`` for every i from 0.

        A longer prefix moves a piece's border in two places only: the blanks a chunk begins with are one
        piece until something follows them, and a contraction (``'ll``) is two pieces until it is whole.
        """
        blanks = self.blank_run.match(chunk).end()
        out = self.char_counts(chunk[:blanks])
        at = spent = 0
        for p in self.pieces(chunk):
            if at + len(p) > blanks:
                if p[0] == "'" and len(p) in (2, 3):
                    counts = [sum(self.piece_total(q.encode()) for q in self.pieces(p[:i])) for i in range(len(p) + 1)]
                else:
                    counts = self.char_counts(p)
                out += [spent + c for c in counts[max(1, blanks + 1 - at) :]]
            spent += self.piece_total(p.encode())
            at += len(p)
        return out

    def __missing__(self, chunk: bytes) -> int:
        n = self.old.get(chunk)
        if n is None:
            n = self.total(chunk)
        if len(self) >= self.limit:  # the full cache becomes the old generation
            self.old = dict(self)
            self.clear()
        self[chunk] = n
        return n

    def plain(self, text: bytes) -> bool:
        """Whether all chunk borders are at ASCII blanks."""
        return not any(s in text for s in self.special) and (self.odd is None or text.isascii() or self.odd.search(text.decode()) is None)

    def encode(self, text: bytes) -> int:
        return len(self.encoder.encode(text.decode(), add_special_tokens=False).ids)

    def cells(self, text: bytes) -> Iterator[tuple[bytes, str]]:
        """The chunks, each with the special string that follows it (or an empty one)."""
        if self.plain(text):
            for part in segments(text):
                for chunk in _CHUNK.findall(part):
                    yield chunk, ""
            return
        parts = self.special_strings.split(text.decode()) if self.special_strings else [text.decode()]
        for part, special in zip(parts[::2], [*parts[1::2], ""]):
            chunks = self.chunk.findall(part) or [""] * bool(special)
            for chunk in chunks[:-1]:
                yield chunk.encode(), ""
            for chunk in chunks[-1:]:
                yield chunk.encode(), special

    def cell_prefixes(self, chunk: bytes, special: str) -> list[int]:
        """Counts at every code point of a cell.  Special strings count as such once they are whole."""
        inside = self.prefixes(chunk.decode())
        if special:
            total = inside[-1] + 1
            inside += [self.count(chunk + special[:i].encode()) for i in range(1, len(special))] + [total]
        return inside

    def count(self, text: bytes) -> int:
        if self.plain(text):
            return sum(sum(map(self.__getitem__, _CHUNK.findall(part))) for part in segments(text))
        return sum(self[chunk] + (special != "") for chunk, special in self.cells(text))

    def cut(self, text: bytes, budget: int) -> int:
        """The most code points of a text whose tokens fit the budget: chunks are passed until it is spent.

        No count inside a cell or after it is below the one at its start, so the first cell that ends
        beyond the budget is the last to look into.
        """
        at = spent = 0
        for chunk, special in self.cells(text):
            n = self[chunk] + (special != "")
            if spent + n > budget:
                return at + max(j for j, c in enumerate(self.cell_prefixes(chunk, special)) if spent + c <= budget)
            spent += n
            at += len(chunk.decode()) + len(special)
        return at

    def profile(self, text: bytes) -> "PrefixProfile":
        return PrefixProfile(self, text)


class PrefixProfile:
    """Counts at all prefixes of one text: running sums at chunk borders, the chunk's own counts between."""

    def __init__(self, counter: PrefixCounter, text: bytes):
        self.counter, self.at, self.sums, self.cells = counter, [0], [0], []
        for chunk, special in counter.cells(text):
            self.cells.append((chunk, special))
            self.at.append(self.at[-1] + len(chunk.decode()) + len(special))
            self.sums.append(self.sums[-1] + counter[chunk] + (special != ""))

    def count(self, n_chars: int) -> int:
        """Tokens of the first ``n_chars`` code points."""
        i = bisect_right(self.at, n_chars) - 1
        if self.at[i] == n_chars or i + 1 == len(self.at):
            return self.sums[i]
        return self.sums[i] + self.counter.cell_prefixes(*self.cells[i])[n_chars - self.at[i]]

    def cut(self, budget: int) -> int:
        """The most code points whose tokens fit the budget.  Counts at cell borders never fall."""
        i = bisect_right(self.sums, budget) - 1
        if i + 1 == len(self.at):
            return self.at[-1]
        return self.at[i] + max(j for j, c in enumerate(self.counter.cell_prefixes(*self.cells[i])) if self.sums[i] + c <= budget)


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    return _COUNTERS.get(path) or _COUNTERS.setdefault(path, PrefixCounter(path))


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """A row for each document: the id, ``n_bytes``, ``n_tokens``, ``over_limit`` and ``limit_chars``, the
    code points that fit the limit (null if all do)."""
    path = vocabulary or default_vocabulary()

    def make() -> Callable:
        counts = counter(path)

        def count(value: bytes) -> list[tuple]:
            n = counts.count(value)
            return [(len(value), n, n > limit, counts.cut(value, limit) if n > limit else None)]

        return count

    schema = [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType()), ("limit_chars", T.LongType())]
    return map_texts(docs, doc_id, text, make, schema)
