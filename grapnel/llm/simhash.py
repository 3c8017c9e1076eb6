"""SimHash near-dedup with Golay-code keys.

Fingerprints: the majority bit over the XXH64 hashes of a text's word shingles.  Two link if they
differ in at most three bits.

Method.  Three errors over four segments of 16 bits leave one segment exact; the other 48 bits are two
halves, one of which has at most one error.  The binary Golay code of length 23 is perfect: every word
lies within three bits of exactly one codeword.  The codewords that decode a half or one of its 23
one-bit neighbours (one or six of them) are its indices; two halves that differ in at most two bits
have a neighbour in common and so an index in common.  A key is (which segments, the exact segment, a
codeword index): 28 bits of text, 8 to 48 keys a fingerprint.  Fingerprints meet on keys and are
verified by their difference.

Only distinct fingerprints get keys.  A key's fingerprints are not written out as pairs: the task that
holds the sorted run joins its members' components, so a run of m members sends at most m rows on.
Long runs are cut by further exact blocks first, and by neighbour search where those don't help, so
work grows about linearly with a run.

Defined results.  Null and empty texts have fingerprint zero, which links like any other.  The component
is the smallest id reachable, nulls aside; it is null where all ids are.  Repeated rows come back as often
as they came in; further columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from grapnel.llm.batches import map_texts
from grapnel.llm.components import components
from grapnel.scratch import materialize

SHINGLE = 3
SEED = 42
DISTANCE = 3
PAIRED = 24  # runs up to this length are compared by shifts
MATRIX = 1500  # and up to this length by a matrix
HOT = 1024  # a fingerprint of more than one document in so many is placed by broadcast
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, of the binary Golay code


def fingerprinter(width: int = SHINGLE, seed: int = SEED, block: int = 1 << 15) -> Callable[[], Callable]:
    def make() -> Callable:
        from xxhash import xxh64_digest

        def fingerprint(text: bytes) -> list[tuple[int]]:
            words = text.lower().split()  # of bytes: A-Z only, ASCII blanks only
            if not words:
                return [(0,)]
            shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else iter([b" ".join(words)])
            counts, n = np.zeros(64, np.int64), 0
            while part := b"".join([xxh64_digest(s, seed) for s in itertools.islice(shingles, block)]):
                bits = np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1)
                counts += bits.sum(axis=0, dtype=np.int32)
                n += len(bits)
            return [(int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big", signed=True),)]

        return fingerprint

    return make


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``fp``, the 64 bits as a long."""
    return map_texts(docs, doc_id, text, fingerprinter(), [("fp", T.LongType())])


class Golay:
    """Decoding of 23-bit words to 12-bit codeword indices, over arrays."""

    def __init__(self):
        self.low = self.syndrome(np.arange(1 << 12, dtype=np.uint32))
        self.high = self.syndrome(np.arange(1 << 11, dtype=np.uint32) << 12)
        flips = [1 << i for i in range(23)]
        self.error = np.zeros(2048, np.uint32)  # by syndrome: the one error pattern of up to three bits
        patterns = np.array([0, *flips, *(a | b for a, b in itertools.combinations(flips, 2)), *(a | b | c for a, b, c in itertools.combinations(flips, 3))], np.uint32)
        self.error[self.of(patterns)] = patterns
        self.near = np.zeros((2048, 6), np.uint32)  # by syndrome: what turns the word into each near codeword
        self.n_near = np.zeros(2048, np.int64)
        moves = np.array([0, *flips], np.uint32)
        for s in range(2048):
            # a word of syndrome s and move e has syndrome s ^ syn(e); it decodes by that error pattern
            found = np.unique(moves ^ self.error[s ^ self.of(moves)])
            self.near[s, : len(found)], self.n_near[s] = found, len(found)

    @staticmethod
    def syndrome(words: np.ndarray) -> np.ndarray:
        rest = words.astype(np.uint32).copy()
        for bit in range(22, 10, -1):
            rest ^= np.where(rest >> bit & 1, np.uint32(GENERATOR << (bit - 11)), np.uint32(0))
        return rest

    def of(self, words: np.ndarray) -> np.ndarray:
        return self.low[words & 0xFFF] ^ self.high[words >> 12]

    def indices(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which word, codeword index): one or six a word.  An index is the codeword's upper 12 bits."""
        s = self.of(words)
        n = self.n_near[s]
        which = np.repeat(np.arange(len(words)), n)
        slot = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        return which, (words[which] ^ self.near[s[which], slot]) >> 11


def keys_of(fps: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(key, fingerprint) rows of uint64 fingerprints."""
    keys, rows = [], []
    for exact in range(4):
        shift = np.uint64(16 * exact)
        kept = (fps >> shift) & np.uint64(0xFFFF)
        rest = (fps & ((np.uint64(1) << shift) - np.uint64(1))) | ((fps >> (shift + np.uint64(16))) << shift if exact < 3 else np.uint64(0))
        for half in range(2):
            words = ((rest >> np.uint64(24 * half)) & np.uint64(0x7FFFFF)).astype(np.uint32)  # 23 of its 24 bits
            which, index = code.indices(words)
            keys.append((np.uint64(2 * exact + half) << np.uint64(28)) | (kept[which] << np.uint64(12)) | index.astype(np.uint64))
            rows.append(fps[which])
    return np.concatenate(keys), np.concatenate(rows)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code = Golay()
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for at in range(0, len(fps), 8192):
            keys, rows = keys_of(fps[at : at + 8192], code)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(rows.view(np.int64))], names=["key", "fp"])


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place in its component for each of n places."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        least = np.minimum(x, y)
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        while (jumped := label[label]).sum() != label.sum():
            label = jumped
        open_ = label[a] != label[b]
        if not open_.any():
            break
        a, b = a[open_], b[open_]
    return label


def run_links(fps: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links (places) that join all of the sorted distinct ``fps`` which are reachable from one another."""
    n = len(fps)
    if n <= MATRIX:
        a, b = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance, 1))
    else:
        found, differ = [], np.bitwise_or.reduce(fps ^ fps[0])
        free = [i for i in range(64) if int(differ) >> i & 1]
        size = -(-len(free) // 6)
        blocks = [sum(1 << i for i in free[k : k + size]) for k in range(0, len(free), size)] if size > 4 else []
        if len(blocks) > distance:
            for touched in itertools.combinations(range(len(blocks)), distance):
                mask = np.uint64(sum(blocks[k] for k in range(len(blocks)) if k not in touched))
                order = np.argsort(fps & mask, kind="stable")
                edges = np.flatnonzero(np.diff(fps[order] & mask)) + 1
                for part in np.split(order, edges) if len(edges) < n - 1 else ():
                    if len(part) > 1:
                        part = np.sort(part)
                        x, y = run_links(fps[part], distance)
                        found.append((part[x], part[y]))
        else:
            for k in range(1, distance + 1):
                for bits in itertools.combinations(free, k):
                    wanted = fps ^ np.uint64(sum(1 << i for i in bits))
                    at = np.minimum(np.searchsorted(fps, wanted), n - 1)
                    hit = np.flatnonzero((fps[at] == wanted) & (at > np.arange(n)))
                    found.append((hit, at[hit]))
        a, b = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (list(zip(*found)) or ([], [])))
    label = _labels(n, a, b)
    moved = np.flatnonzero(label != np.arange(n))
    return label[moved], moved


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, fp) rows to links; a run that goes on in the next batch waits for it."""
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = [], []
        if len(key):
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            for i in np.flatnonzero(sizes > PAIRED):
                run = fp[starts[i] : starts[i] + sizes[i]]
                x, y = run_links(run)
                a.append(run[x])
                b.append(run[y])
            small = np.repeat((sizes > 1) & (sizes <= PAIRED), sizes)
            k, f = key[small], fp[small]
            for d in range(1, PAIRED):
                same = np.flatnonzero(k[d:] == k[:-d])
                if not len(same):
                    break
                near = same[np.bitwise_count(f[same] ^ f[same + d]) <= DISTANCE]
                a.append(f[near])
                b.append(f[near + d])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (a, b))
        pairs = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i]).view(np.int64)) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        last = int(np.searchsorted(key, key[-1]))
        if waiting and (last == 0) and waiting[-1][0][-1] == key[0]:
            waiting.append((key, fp))
            continue
        waiting.append((key[:last], fp[:last]))
        yield links(*(np.concatenate(x) for x in zip(*waiting)))
        waiting = [(key[last:], fp[last:])]
    if waiting:
        yield links(*(np.concatenate(x) for x in zip(*waiting)))


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (column ``fp``) that join every reachable pair."""
    rows = fps.select("fp").mapInArrow(_keys, "key long, fp long")
    # fingerprints sort as unsigned numbers: flip the sign bit
    sorted_ = rows.repartition("key").sortWithinPartitions("key", F.col("fp").bitwiseXOR(F.lit(-(1 << 63)).cast("long")))
    return sorted_.mapInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: the id, ``fp`` (long) and ``component_id``.

    Fingerprints of more than one document in ``HOT`` get theirs by broadcast, as there are fewer than ``HOT`` of
    these whatever the input; so no task of the last join holds more than that share for one fingerprint.
    """
    marked = materialize(fingerprints(docs, doc_id, text), "fingerprints")
    least = marked.groupBy("fp").agg(F.min(doc_id).alias("__least"), F.count("*").alias("__n"))
    roots = components(fingerprint_links(least)).withColumnRenamed("node", "fp")
    joined = roots.join(least, "fp")
    smallest = joined.groupBy("root").agg(F.min("__least").alias("__component"))
    linked = roots.join(smallest, "root").select("fp", "__component")
    assigned = materialize(least.join(linked, "fp", "left").select("fp", "__n", F.coalesce("__component", "__least").alias("component_id")), "components")
    hot = F.broadcast(assigned.where(F.col("__n") * HOT > marked.count()).select("fp", "component_id"))
    rest = marked.join(hot.select("fp"), "fp", "left_anti").join(assigned.select("fp", "component_id"), "fp")
    return marked.join(hot, "fp").unionByName(rest).select(doc_id, "fp", "component_id")


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
