"""Plain Python versions of the operators: slow, short, and written from the contracts alone."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import public_tokenizers
import xxhash
from tokenizers import Tokenizer

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def line_dedup(docs):
    """docs: (doc_id, text), ids distinct."""
    key = lambda x: x.strip(BLANK).translate(LOWER)
    held = collections.defaultdict(set)
    for d, t in docs:
        for x in (t or "").split("\n"):
            held[key(x)].add(d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(key(x)) < 10 or min(held[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(keep), sha("\n".join(keep))))
    return out


def quality(docs):
    out = []
    for d, t in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {j for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if x.strip(BLANK)]
        out.append((d, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    return out


def norm_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def licenses(docs):
    base = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
    out = []
    for d, t in docs:
        w = norm_words(t)
        at = sorted((i, label) for p, label in base for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        out.append((d, len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))))
    return out


def secrets(docs):
    kinds = (
        ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
    )
    out = []
    for d, t in docs:
        found = [(m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(kinds) for m in p.finditer(t or "") if ok(m)]
        n = collections.Counter(x[1] for x in found)
        out.append((d, n[0], n[1], n[2], sha(",".join(f"{name}:{s}:{e}" for s, _, name, e in sorted(found)))))
    return out


def contamination(docs, items, width=10):
    windows = collections.defaultdict(set)
    for item, t in items:
        w = norm_words(t)
        for i in range(max(1, len(w) - width + 1)) if w else ():
            windows[tuple(w[i : i + width])].add(str(item))
    sizes = sorted({len(x) for x in windows})
    out = []
    for d, t in docs:
        w, hit, ids = norm_words(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if got := windows.get(tuple(w[i : i + n])):
                    ids |= got
                    hit.update(range(i, i + n))
        out.append((d, len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit)))
    return out


def token_counts(docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [(d, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 1024) for d, x in docs]


def pieces_ok(docs, packed):
    """Nothing if the packed rows are right, else what is wrong."""
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in packed:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, x in docs:
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(by_doc.pop(d), key=lambda r: r["start"]):
            part = ids[at : at + r["length"]]
            if (r["start"], r["doc_tokens"]) != (at, len(ids)) or zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)) != r["ids_crc32"]:
                return f"document {d}: {r}"
            at += r["length"]
        if at != len(ids):
            return f"document {d}: {at} of {len(ids)}"
    if by_doc:
        return f"pieces of no document: {list(by_doc)[:3]}"
    for s, parts in by_seq.items():
        at = 0
        for o, n in sorted(parts):
            if o != at:
                return f"sequence {s}: a gap at {at}"
            at += n
        if at > 2048:
            return f"sequence {s}: {at}"
    return None


def chats(turns):
    """turns: (conv_id, turn, role, text), with the control conversation."""
    by = collections.defaultdict(list)
    for c, n, r, t in turns:
        by[c].append((n, r or "", t or ""))
    out = []
    for c, rows in by.items():
        rows.sort()
        loss = "".join(t for _, r, t in rows if r == "assistant")
        out.append((c, len(rows), sha("".join(f"{r}\n{t}\n" for _, r, t in rows)), len(loss), sha(loss)))
    return out


def fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def simhash(docs):
    fps = [(d, fingerprint(t)) for d, t in docs]
    distinct = sorted({f for _, f in fps})
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            root[f] = f = root[root[f]]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(b)] = find(a)
    least = {}
    for d, f in fps:
        if d is not None:  # null ids never name a component
            least[find(f)] = min(d, least.get(find(f), d))
    return [(d, f"{f:016x}", least.get(find(f))) for d, f in fps]
