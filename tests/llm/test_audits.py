"""Operators 11 to 13 against plain versions, and the cases that their docstrings define."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor

import numpy as np
import pytest

from loomspan.llm import common, contamination, divergence, vector_codes
from loomspan.llm.queries import op12_vector_codes

SCHEMA = "doc_id long, text string, lang string, source string"
#: Extra columns whose names operators use inside, or that need quoting.
CLASHING = ("row", "term", "counts", "n", "d", "a b", "x-y", "spans", "items", "shingle", "code", "error")


def _clashing(df):
    for c in CLASHING:
        df = df.selectExpr("*", f"'-' as `{c}`")
    return df.selectExpr("*", "named_struct('a b', 1, 'text', 'x') as nested")


def _sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def _lower(t: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


# 11


def _audited(rows, least, top):
    """Every term of every group compared with every other, one by one."""
    words = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", _lower(text or ""))) for _, text, lang, source in rows]
    seen = defaultdict(Counter)
    for lang, _, w in words:
        seen[lang].update(set(w))
    kept = {lang: sorted((t for t, n in c.items() if n >= least), key=str.encode) for lang, c in seen.items()}
    counts = defaultdict(Counter)
    for lang, source, w in words:
        counts[lang, source].update(t for t in w if t in set(kept[lang]))
    out = []
    for lang, source in counts:
        terms = kept[lang]
        p = lambda c, n, v=len(terms): 1 + (10**9 * (c + 5)) // (n + 5 * v)
        sources = [s for x, s in counts if x == lang]
        total = {s: sum(counts[lang, s].values()) for s in sources}
        mine = lambda s, t, lang=lang, total=total, p=p: p(counts[lang, s][t], total[s])
        pairs = [(sum(abs(mine(source, t) - mine(s, t)) for t in terms), s) for s in sources if s != source]
        whole = lambda t, lang=lang, sources=sources, total=total, p=p: p(sum(counts[lang, s][t] for s in sources), sum(total.values()))
        own = [(mine(source, t) - whole(t), t) for t in terms if counts[lang, source][t] and mine(source, t) > whole(t)]
        for part, found, most in (("pair", pairs, None), ("term", own, top)):
            ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
            out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return out


def _texts(seed=2, n=160):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdeéñß中", k=r.randint(1, 4))) for _ in range(90)]
    rows = []
    for i in range(n):
        source = r.choice(["s1", "s1", "s1", "s2", "s3", "s10", None, ""])
        lean = vocab[: 10 + 10 * len(source or "")]
        text = " ".join(r.choices(lean if r.random() < 0.6 else vocab, k=r.randint(0, 60))).title() + r.choice(["", ".", " A1b2_C", "\tÉÀ@[`{"])
        rows.append((i, text, r.choice(["en", "en", "fr", None]), source))
    rows += [rows[0], rows[0], (None, None, "de", "only"), (7, None, "en", "wordless"), (8, "12 ...", "en", "wordless"), (9, rows[3][1] * 30, "en", "s2")]
    return rows


@pytest.mark.parametrize(("least", "top"), [(3, 7), (30, 50)])
def test_divergence(spark, least, top):
    rows = _texts()
    df = _clashing(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert Counter(map(tuple, divergence.audit(df, least, top).collect())) == Counter(_audited(rows, least, top))


def test_divergence_sends_on_what_it_holds(spark, monkeypatch):
    """Tasks that pass their bound send what they have, and long texts are cut at blanks."""
    rows = _texts(5)
    tables = [divergence._TABLE]
    for text in ("ab " * 50 + "x" * 40 + " c", "x" * 100, "", " ", "é" * 30 + " b"):
        for most in (1, 7, 1000):
            pieces = list(common.text_pieces(text.encode(), tables[0], most))
            assert b"".join(pieces) == text.encode().translate(tables[0]) and all(p.endswith(b" ") for p in pieces[:-1] if p.strip() and p is not pieces[-2])
    batch = spark.createDataFrame(rows, SCHEMA).select("lang", "source", "text").toArrow().to_batches()[0]
    whole = Counter()
    for held in (3, 200_000):
        monkeypatch.setattr(divergence, "HELD", held)
        summed = Counter()
        for out in divergence._counted(iter([batch.slice(i, 20) for i in range(0, batch.num_rows, 20)])):
            for row in out.to_pylist():
                summed[row["lang"], row["source"], row["term"]] += row["n"] + 1000 * row["d"]
        assert not whole or whole == summed
        whole = summed


def test_divergence_without_rows_and_alone(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = spark.createDataFrame([(0, "word word", "en", "a"), (1, "word", "fr", "b"), (2, None, "fr", "c")], SCHEMA)
    got = {tuple(r) for r in divergence.audit(alone, 2).collect()}
    assert got == {("fr", "b", "pair", "c", 0, 1), ("fr", "c", "pair", "b", 0, 1)}


# 12


def _coded(rows, parts=4, entries=256, rounds=4):
    """Every part against every entry, in Python integers."""
    kept = [(i, label, v) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // parts
    kept = [r for r in kept if len(r[2]) == parts * width]
    whole = [[floor(Fraction(x) * 1024) for x in v] for _, _, v in kept]
    codes, errors = [[] for _ in kept], [0] * len(kept)
    books = []
    for p in range(parts):
        part = [w[p * width : (p + 1) * width] for w in whole]
        book = [list(x) for x in part[:entries]]
        for r in range(rounds + 1):
            near = [min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book)) for x in part]
            if r < rounds:
                for k in range(len(book)):
                    own = [x for x, (_, at) in zip(part, near, strict=True) if at == k]
                    if own:
                        book[k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
        books += [str(v) for e in book for v in e]
        for i, (d, k) in enumerate(near):
            codes[i].append(k)
            errors[i] += d
    labels = Counter()
    for (_, label, _), e in zip(kept, errors, strict=True):
        labels[label] += e
    return [(i, label, tuple(c), e, labels[label], _sha(",".join(books))) for (i, label, _), c, e in zip(kept, codes, errors, strict=True)]


def _vectors(n=150, dims=8, seed=0, scale=0.2):
    r = np.random.default_rng(seed)
    x = (scale * r.standard_normal((n, dims))).astype(np.float32)
    x[20:60] = x[19]  # one very common vector
    return [(int(i), v.tolist(), int(i) % 3 if i % 7 else None) for i, v in zip(r.permutation(n), x, strict=True)]


@pytest.mark.parametrize("scale", [0.2, 5000.0])
def test_vector_codes(spark, scale):
    """Small components go through bounds, large ones through Python integers."""
    rows = _vectors(scale=scale)
    odd = [(None, rows[0][1], 1), (5, rows[7][1], 2), (300, None, 1), (301, [1.0] * 7 + [None], 1), (302, [1.0] * 7 + [float("inf")], 1), (303, [float("nan")] * 8, 1), (304, [1.0] * 4, 1), (305, [], 1)]
    df = _clashing(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").repartition(3))
    got = vector_codes.compressed(df, entries=16, rounds=3).selectExpr("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")
    assert Counter((r.vec_id, r.label, tuple(r.code), *tuple(r)[3:]) for r in got.collect()) == Counter(_coded(rows + odd, entries=16, rounds=3))


def test_vector_codes_of_few_rows(spark):
    kind = "vec_id long, embedding array<double>, label string"
    assert vector_codes.compressed(spark.createDataFrame([], kind)).count() == 0
    assert vector_codes.compressed(spark.createDataFrame([(1, None, "a")], kind)).count() == 0
    two = spark.createDataFrame([(1, [1e30, 0.0, -1e-9, 0.5], None), (2, [1e30, 0.0, 0.0, 0.5], None)], kind)
    got = {r.vec_id: r for r in vector_codes.compressed(two).collect()}
    assert got[1].code == [0, 0, 0, 0] and got[2].code == [0, 0, 1, 0] and got[1].label_error == 0
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compressed(spark.createDataFrame([(1, [1.0] * 6, "a")], kind))


def test_bounds_are_conservative_and_prune():
    r = np.random.default_rng(3)
    for spread, most in ((0.05, 0.05), (1.0, 0.8)):
        centres = r.integers(-900, 900, (64, 16))
        x = centres[r.integers(0, 64, 3000)] + np.floor(spread * 400 * r.standard_normal((3000, 16))).astype(np.int64)
        book = vector_codes.Codebook(centres)
        index, error = book.nearest(x)
        full = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
        assert (index == full.argmin(axis=1)).all() and (error == full.min(axis=1)).all()
        assert book.left < most * book.seen


def test_codes_of_the_drivers_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding", "label").limit(300).collect()
    want = {(i, "".join(f"{x:02x}" for x in c), e) for i, _, c, e, _, _ in _coded([tuple(r) for r in rows], rounds=1)}
    made = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = vector_codes.compressed(made, rounds=1).collect()
    assert {(r.vec_id, "".join(f"{x:02x}" for x in r.code), r.error) for r in got} == want
    assert op12_vector_codes(spark, "/root/testdata/sf0.001").columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


# 13


def _contaminated(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= own
        out.append((i, len(w), len(hit), len(found), _sha(",".join(sorted(found, key=str.encode))), bool(hit)))
    return out


def _benchmark():
    r = random.Random(4)
    vocab = ["".join(r.choices("abcdé", k=r.randint(1, 3))) for _ in range(200)]
    prose = lambda n: " ".join(r.choices(vocab, k=n))
    items = [(i, prose(r.randint(10, 60)).title()) for i in range(30)]
    shared = prose(12)
    items += [(100 + i, f"{prose(4)} {shared}") for i in range(6)]
    items += [(200, "Qux quux!"), (201, "solo-word9"), (202, "Zap"), (203, ""), (204, None), (205, "..."), (206, "one two three four five six seven eight nine"), (None, prose(20)), (3, prose(15)), (5, items[5][1])]
    docs = []
    for i in range(120):
        parts = [prose(r.randint(0, 40))]
        for _ in range(r.randint(0, 3)):
            w = (r.choice(items)[1] or "x").split()
            k = r.randrange(len(w) or 1)
            parts += [" ".join(w[k : k + r.randint(1, 30)]).upper(), r.choice([prose(3), "zap", "zapp", "QUX. quux", "qux x quux", "solo word9", shared])]
        docs.append((i, " -- ".join(parts)))
    docs += [docs[3], docs[3], (None, docs[4][1]), (None, None), (500, ""), (501, "..."), (7, shared * 2), (502, f"{shared} " * 300), (503, " ".join(items[0][1].split()[:9])), (504, items[0][1][:-1])]
    return docs, items


def _reported(spark, docs, items):
    made = _clashing(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    bench = _clashing(spark.createDataFrame(items, "item_id long, text string"))
    return contamination.report(contamination.matched(made, bench))


@pytest.mark.parametrize("piece", [1 << 20, 40])
def test_contamination(spark, monkeypatch, piece):
    """Whole texts, and texts cut into many pieces that overlap."""
    docs, items = _benchmark()
    if piece < 1 << 20:
        cut = common.text_pieces
        segments = contamination._segments(["".join(d[1] or "") .encode() for d in docs])
        whole = [[w for s in segments_ for w in s] for segments_ in ()] or [s.words for s in segments]
        monkeypatch.setattr(contamination, "text_pieces", lambda text, table: cut(text, table, piece))
        own = defaultdict(list)
        for s in contamination._segments([(d[1] or "").encode() for d in docs]):
            assert s.base + s.own[0] == len(own[s.row])
            own[s.row] += s.words[s.own[0] : s.own[1]]
        assert [own[i] for i in range(len(docs))] == whole
        # the tasks' own code runs here, as a worker wouldn't see the patch
        got = Counter()
        for row in _local(docs, items):
            got[row] += 1
        assert got == Counter(r[:4] for r in _contaminated(docs, items))
        return
    assert Counter(map(tuple, _reported(spark, docs, items).collect())) == Counter(_contaminated(docs, items))


class _Shared:
    def __init__(self, value):
        self.value = value


class _Set:
    """Stands for the bitmap: shingles in a set."""

    def __init__(self, wanted):
        self.wanted, self.sizes = wanted, [1, 2, 3]

    def holds(self, h):
        return np.array([int(x) in self.wanted for x in h], bool)


def _local(docs, items):
    """doc_id, n_words, n_hit, n_items by the functions that tasks run, joined in Python."""
    import pyarrow as pa

    bench = pa.RecordBatch.from_pydict({"item": ["" if i is None else str(i) for i, _ in items], "text": [t or "" for _, t in items]})
    windows = defaultdict(lambda: ([], set()))
    for out in contamination._windows(iter([bench])):
        for w in out.to_pylist():
            windows[w["window"]][1].add(w["item"])
            windows[w["window"]][0][:] = [w["words"], [x % 2**64 for x in w["shingles"]]]
    texts = pa.RecordBatch.from_pydict({"doc_id": pa.array([d[0] for d in docs], pa.int64()), "text": [d[1] or "" for d in docs]})
    wanted = {x for (_, s), _ in windows.values() for x in s}
    n = Counter()
    for out in contamination._frequencies(_Shared(_Set(wanted)))(iter([texts])):
        for r in out.to_pylist():
            n[r["shingle"] % 2**64] += r["n"]
    prefix = defaultdict(list)
    for window, ((words, shingles), own) in windows.items():
        if all(n[s] for s in shingles):
            s = min(shingles, key=lambda s: (n[s], s))
            prefix[s].append((shingles.index(s), words, window, own))
    longest = max(len(w.encode()) for window in windows for w in window.split())

    class Context:
        @staticmethod
        def get():
            return Context()

        def partitionId(self):  # noqa: N802
            return 3

    held, contamination.TaskContext = contamination.TaskContext, Context
    try:
        rows, hit, found = {}, defaultdict(set), defaultdict(set)
        for out in contamination._places(_Shared(_Set(set(prefix))), longest)(iter([texts])):
            for r in out.to_pylist():
                if r["place"] is None:
                    rows[r["row"]] = (r["doc_id"], r["n_words"])
                    continue
                for offset, words, window, own in prefix[r["shingle"] % 2**64]:
                    at = r["left"] - offset
                    if at >= 0 and at + words <= len(r["around"]) and " ".join(r["around"][at : at + words]) == window:
                        hit[r["row"]] |= set(range(r["place"] - offset, r["place"] - offset + words))
                        found[r["row"]] |= own
    finally:
        contamination.TaskContext = held
    return [(i, n_words, len(hit[k]), len(found[k])) for k, (i, n_words) in rows.items()]


def test_contamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id string, text string")
    got = {tuple(r)[:4] + (r.contaminated,) for r in contamination.report(contamination.matched(docs, none)).collect()}
    assert got == {(1, 2, 0, 0, False), (2, 0, 0, 0, False)}
    items = spark.createDataFrame([("x", "some")], "item_id string, text string")
    assert contamination.matched(docs.limit(0), items).count() == 0
    spans = {r.doc_id: (r.spans, r["items"]) for r in contamination.matched(docs, items).collect()}
    assert [tuple(s) for s in spans[1][0]] == [(0, 1)] and spans[1][1] == ["x"] and spans[2] == ([], [])


def test_crowded_bitmap(spark, monkeypatch):
    """A bitmap that holds nearly everything changes nothing but what is sent around."""
    monkeypatch.setattr(contamination, "FEWEST", 64)
    monkeypatch.setattr(contamination, "MOST", 64)
    docs, items = _benchmark()
    assert Counter(map(tuple, _reported(spark, docs[:40], items).collect())) == Counter(_contaminated(docs[:40], items))


def test_very_long_texts(spark):
    r = random.Random(9)
    vocab = ["".join(r.choices("abcdefgh", k=6)) for _ in range(3000)]
    passage = " ".join(r.choices(vocab, k=30))
    long_ = " ".join(r.choices(vocab, k=200_000))
    docs = [(1, f"{long_} {passage} {long_}"), (2, "y" * 3_000_000 + " " + passage), (3, long_)]
    found = {r.doc_id: r for r in contamination.matched(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(0, passage)], "item_id long, text string")).collect()}
    assert [tuple(s) for s in found[1].spans] == [(200_000, 30)] and [tuple(s) for s in found[2].spans] == [(1, 30)] and found[3].spans == []
    assert found[1].n_words == 400_030
