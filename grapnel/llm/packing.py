"""Packing: documents cut into pieces and packed into sequences of one length, with little padding.

Method.  A document's ids are cut into full sequences and one remainder.  Pieces are dealt at random
into groups of about :data:`GROUP_PIECES`; each group runs first-fit decreasing by itself, where a
tournament tree over the bins' free room finds the first bin that fits in O(log n).  Groups are
independent, so a lost executor costs its groups only, and no task ever holds more than a group.

Tokens are made once.  Checksums are taken while the ids are at hand; what is shuffled is a few numbers
a piece.  The pieces are written to the shared folder with an ordinal that deals them, so hot or null
ids can't crowd a group and a repeated task gives the same answer.

Defined results.  A null or empty text is its end id alone.  Rows are packed one by one, so repeated
rows are packed as often as they come; further columns are ignored; an empty table has no pieces.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from grapnel.llm.batches import map_texts, segments
from grapnel.llm.token_counts import byte_letters
from grapnel.scratch import materialize

LENGTH = 2048
END_ID = 1
GROUP_PIECES = 4096
CACHE_WORDS = 400_000
VOCABULARY = "word_bpe_49k.json"


def default_vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Words that need no normalisation but lower case, and what one piece is in them: ASCII and Latin letters.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ɏ"
_PLAIN = re.compile(f"[!-~{_LETTERS}]+")
_STOP = re.compile(rb"(?<=[A-Za-z])([.,])(?=[ \t\n\r\x0b\x0c]|\Z)")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^0-9{_LETTERS}]+")


class WordIds(dict):
    """Little-endian ids of words, each encoded once.  This vocabulary drops white space before it merges,
    so a text's ids are its words' ids in a row.

    Plain words are cut into pieces here and given to the vocabulary's merges; others go through the
    whole tokenizer.  When the cache is full it becomes the old generation, from which words come back.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder, self.limit = Tokenizer.from_file(path), limit
        self.merges = self.encoder.model
        self.special = [t.content for t in self.encoder.get_added_tokens_decoder().values()]
        self.begins = [s[:2].encode() for s in self.special]
        self.letters = {b: c for c, b in byte_letters().items()}
        self.old: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.merges.tokenize(spelled)]
        if len(self.pieces) >= self.limit:
            self.pieces.clear()
        found = self.pieces[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def __missing__(self, word: bytes) -> bytes:
        found = self.old.get(word)
        if found is None:
            text, known = word.decode(), self.pieces
            if text.isascii() and text.isalpha():
                low = text.lower()
                found = known.get(low) or self.piece(low)
            elif _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
                low = text.lower()
                body = low[:-1]
                if low[-1] in ".," and body.isalpha():
                    parts = (body, low[-1])
                else:
                    parts = (low,) if low.isalpha() else _PIECES.findall(low)
                found = b"".join([known.get(p) or self.piece(p) for p in parts])
            else:
                ids = self.encoder.encode(text, add_special_tokens=False).ids
                found = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found

    def ids(self, text: bytes) -> bytes:
        """Ids of a text.  Fewer distinct words mean fewer to encode, so ASCII is lower-cased first, which the
        vocabulary does anyway (not where marks might compose otherwise, or a special string might come
        about), and a full stop or comma between a letter and a blank, a piece of its own, stands apart."""
        if b"\xcc" not in text and b"\xcd" not in text and not any(s in text for s in self.begins):
            text = text.lower()
        return b"".join(map(self.__getitem__, _STOP.sub(rb" \1", text).split()))


_CACHES: dict[str, WordIds] = {}


def cutter(path: str, length: int = LENGTH, end_id: int = END_ID) -> Callable[[], Callable]:
    def make() -> Callable:
        words = _CACHES.get(path) or _CACHES.setdefault(path, WordIds(path))
        end = struct.pack("<I", end_id)

        def cut(text: bytes) -> list[tuple]:
            ids = b"".join(map(words.ids, segments(text))) + end
            n = len(ids) // 4
            return [(at, min(length, n - at), zlib.crc32(ids[4 * at : 4 * (at + length)]), n) for at in range(0, n, length)]

        return cut

    return make


PIECE = [("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType())]


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length.  Longest first, ties by place; the first bin with room takes it."""
    size = 1
    while size < max(1, len(lengths)):
        size *= 2
    room = [capacity] * (2 * size)  # a tournament: each node has the most room below it
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need, node = lengths[i], 1
        if need > capacity:
            raise ValueError("a piece exceeds the capacity")
        while node < size:
            node *= 2
            if room[node] < need:
                node += 1
        out[i] = (node - size, capacity - room[node])
        room[node] -= need
        while node > 1:
            node //= 2
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
    return out


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, length: int = LENGTH, end_id: int = END_ID, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """A row a piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    path = vocabulary or default_vocabulary()
    cut = map_texts(docs, doc_id, text, cutter(path, length, end_id), PIECE)
    pieces = materialize(cut.withColumn("__ordinal", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64("__ordinal"), F.lit(groups)))
    schema = T.StructType([*(f for f in pieces.schema if f.name != "__ordinal"), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = [f.name for f in schema]

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("__ordinal", ignore_index=True)
        places = first_fit_decreasing(group["length"].tolist(), length)
        group["sequence_id"] = [(int(group["__group"].iat[0]) << 32) + b for b, _ in places]
        group["offset"] = [o for _, o in places]
        return group[names]

    return dealt.groupBy("__group").applyInPandas(pack, schema)


def padding(packed: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row: sequences, tokens, and the padding that fills sequences up; a power of two needs none."""
    filled = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    two = F.bit_count("n") == 1
    return filled.agg(F.count("*").alias("n_sequences"), F.sum("n").alias("n_tokens"), F.sum(F.when(two, 0).otherwise(length - F.col("n"))).alias("n_padding"))
