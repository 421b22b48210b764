"""Plain single-process versions of the operators, for small tables only."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

BLANKS = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return BLANKS.findall((text or "").encode())


def suffix_dedup(rows, window=200):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for (doc, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = b"\x01" * window
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((doc, len(t), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def substring_dedup(rows, window=50):
    last = 1 << 63
    every = [(last if d is None else d, words(t)) for d, t in rows]
    least = {}
    for d, ws in every:
        for i in range(len(ws) - window + 1):
            w = tuple(ws[i : i + window])
            least[w] = min(least.get(w, last), d)
    out = []
    for (doc, _), (d, ws) in zip(rows, every, strict=True):
        gone = [False] * len(ws)
        for i in range(len(ws) - window + 1):
            if least[tuple(ws[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = b" ".join(w for w, g in zip(ws, gone, strict=True) if not g)
        out.append((doc, len(ws), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def simhash(rows, bits=3):
    fps = []
    for _, text in rows:
        ws = [w.lower() for w in words(text)]
        shingles = [b" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            r = find(i)
            least[r] = min(least.get(r, doc), doc)
    return [(doc, f"{f:016x}", least.get(find(i))) for i, ((doc, _), f) in enumerate(zip(rows, fps, strict=True))]


def _luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and _luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
)


def pii(rows):
    out = []
    for doc, text in rows:
        found, counts = [], []
        for kind, pattern, ok in PII:
            own = [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text or "") if ok(m.group())]
            counts.append(len(own))
            found += own
        out.append((doc, *counts, hashlib.sha256(",".join(found).encode()).hexdigest()))
    return out


def general(kind, value):
    """What a value is generalised to."""
    if kind == 0:
        return value.rpartition("@")[2] if value.count("@") == 1 else value.partition("@")[2]
    if kind == 1:
        return ".".join(value.split(".")[:2])
    return re.sub("[^0-9]", "", value)[:6] if kind == 2 else re.match(r"\+[0-9]{1,3}", value).group()


def pii_spans(rows, reach=80, disclosure=0.9, discount=0.5, common=5):
    """doc_id, all spans, disclosing terms included, and the sanitised text of each row with spans."""
    base, near, holds, terms_of = [], Counter(), Counter(), {}
    letters = re.compile(r"[^\W\d_]+")
    texts = [t or "" for _, t in rows]
    distinct = set(texts)
    for t in distinct:
        terms_of[t] = {w.lower() for w in letters.findall(t)}
    n_t = Counter(w for ws in terms_of.values() for w in ws)
    spans_of, seen_by = {}, {}
    for t in distinct:
        own, pairs = [], set()
        for k, (kind, pattern, ok) in enumerate(PII):
            for m in re.finditer(pattern, t):
                if ok(m.group()):
                    own.append((k, kind, m.start(), m.end()))
                    left, right = t[max(0, m.start() - reach) : m.start()], t[m.end() : m.end() + reach]
                    left, right = re.sub(r"^[^\W\d_]+", "", left), re.sub(r"[^\W\d_]+$", "", right)
                    for e in ((k, m.group().lower()), (k, "~", general(k, m.group().lower()))):
                        pairs |= {(e, None)} | {(e, w.lower()) for w in letters.findall(left) + letters.findall(right)}
        spans_of[t], seen_by[t] = own, {e for e, _ in pairs}
        near.update(p for p in pairs if p[1] is not None)
        holds.update(seen_by[t])
    n = len(distinct)
    told = {}
    for (e, w), both in near.items():
        information = math.log2(n / holds[e])
        if information > 0 and math.log2(n * (both - discount) / (holds[e] * n_t[w])) >= disclosure * information:
            told.setdefault(e, set()).add(w)
    out = []
    for doc, text in rows:
        t = text or ""
        words = set().union(*[told.get(e, set()) for e in seen_by[t]])
        found = list(spans_of[t]) + [(4, "term", m.start(), m.end()) for m in letters.finditer(t) if m.group().lower() in words]
        at, clean = 0, ""
        for a, b, k in sorted((a, b, k) for k, _, a, b in found):
            if a >= at:
                form = general(k, t[a:b].lower()) if k < 4 else None
                shown = "" if k == 4 else f"[{PII[k][0].upper()}{' ' + form if holds[k, '~', form] >= common else ''}]"
                clean += t[at:a] + shown
            at = max(at, b)
        out.append((doc, ",".join(f"{kind}:{a}:{b}" for _, kind, a, b in sorted(found)), clean + t[at:] if found else None))
    return out


def languages(rows, length=300):
    """doc_id, language, score by rank-order profiles; rows: doc_id, text, lang."""

    def grams(text):
        out = Counter()
        for w in re.sub(r"[\W\d_]+", " ", "".join(c if c.isalpha() else " " for c in text.lower())).split():
            padded = f" {w} "
            out.update(g for k in (1, 2, 3) for i in range(len(padded) - k + 1) if (g := padded[i : i + k]) != " ")
        return out

    def ranks(counts):
        return {g: i for i, g in enumerate(sorted(counts, key=lambda g: (-counts[g], g))[:length])}

    by = {}
    for doc, text, lang in rows:
        if zlib.crc32(("" if doc is None else str(doc)).encode()) % 5 and text is not None and lang is not None:
            by.setdefault(lang, Counter()).update(grams(text))
    profiles = {lang: ranks(c) for lang, c in by.items()}
    out = []
    for doc, text, _ in rows:
        own = ranks(grams(text or ""))
        if not own or not profiles:
            out.append((doc, "und", 0.0))
            continue
        far = {lang: sum(min(abs(r - p[g]), length) if g in p else length for g, r in own.items()) for lang, p in profiles.items()}
        best = min(far, key=lambda lang: (far[lang], lang))
        out.append((doc, best, 1 - far[best] / (length * len(own))))
    return out


def mix_times(rows, bits=60, most=3):
    """How often each (doc_id, text) is taken, straight from sorted hashes; rows: doc_id, text, source."""
    size = lambda t: len(words(t))
    key = lambda d, t: int(hashlib.md5(f"{'' if d is None else d}|{t or ''}".encode()).hexdigest()[:15], 16)
    sums = Counter()
    for _, t, s in rows:
        sums[s] += size(t)
    names = sorted((s for s in sums if s is not None)) + [None] * (None in sums)
    weight, total = {s: i % 3 + 1 for i, s in enumerate(names)}, sum(sums.values())
    target, free = {}, set(names)
    while free:
        rest = total - sum(target.values())
        want = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if want[s] > most * sums[s]]
        target.update({s: float(most * sums[s]) for s in over} if over else want)
        free = free - set(over) if over else set()
    out = Counter()
    for s in names:
        whole = int(target[s] // sums[s]) if sums[s] else 0
        budget = target[s] - whole * sums[s]
        own = sorted((key(d, t), size(t), d, t) for d, t, x in rows if x == s)
        upto, taken = 0, set()
        for h in sorted({o[0] for o in own}) if budget > 0 else ():
            n = sum(o[1] for o in own if o[0] == h)
            if upto + n > budget:
                if abs(upto + n - budget) <= abs(upto - budget):
                    taken.add(h)
                break
            taken.add(h)
            upto += n
        for h, _, d, t in own:
            out[(d, t)] += whole + (h in taken)
    return out
