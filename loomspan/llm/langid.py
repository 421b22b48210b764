"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent n-grams of one to three
letters, words padded with a blank. A document goes to the language whose
profile is nearest by out-of-place distance: for each of the document's most
frequent n-grams, how far its rank is from its rank in the profile, or the
profile's length if it isn't there.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepared, slices, written

#: Length of the profiles of languages and documents.
LENGTH = 300
UNKNOWN = "und"
#: Bytes of text whose n-grams are counted together; their arrays take some hundred times as much.
SLICE = 512 << 10


class _Grams:
    """n-grams of a run of texts as numbers: three letters in base `base`, from the left, 0 where an n-gram is shorter.

    Letters are numbered in code-point order (1 is the blank), so numbers sort as the n-grams do.
    """

    def __init__(self, low: list[str], counted: int = 0, closed: bool = True) -> None:
        """low: texts in lower case. A piece of a text begins with `counted` characters whose n-grams another piece counts, and unless `closed` it has no end of its own."""
        # a newline on either side of each text, and anything but a letter becomes the blank
        code = np.frombuffer(("\n" + "\n\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        seen = np.unique(code)
        letter = np.array([chr(c).isalpha() for c in seen.tolist()], bool)
        number = np.ones(len(seen), np.int64)
        number[letter] = np.arange(2, 2 + letter.sum())
        self.chars = [" ", *(chr(c) for c in seen[letter].tolist())]
        self.base = len(self.chars) + 1
        table = np.ones(int(seen[-1]) + 1, np.int32)
        table[seen] = number
        x = table[code]
        doc = np.repeat(np.arange(len(low), dtype=np.int32), [len(t) + 2 for t in low])
        own = np.ones(len(x), bool)  # may end an n-gram
        if counted or not closed:
            own[: counted + 1] = False
            own[-1] = closed
        keep = np.ones(len(x), bool)
        keep[1:] = (x[1:] != 1) | (x[:-1] != 1) | (doc[1:] != doc[:-1])
        x, doc, own = x[keep].astype(np.int64), doc[keep], own[keep]
        b, n = self.base, len(x)
        same1, same2 = doc[1:] == doc[:-1], doc[2:] == doc[:-2]
        one = (x != 1) & own
        # a blank may begin or end an n-gram, no more; one letter counts without blanks
        two = same1 & ((x[1:] != 1) | (x[:-1] != 1)) & own[1:]
        three = same2 & (x[1:-1] != 1) & own[2:]
        self.doc = np.concatenate([doc[one], doc[: n - 1][two], doc[: n - 2][three]]) if n > 2 else doc[:0]
        self.gram = np.concatenate([x[one] * b * b, (x[:-1] * b * b + x[1:] * b)[two], (x[:-2] * b * b + x[1:-1] * b + x[2:])[three]]) if n > 2 else x[:0]

    def text(self, gram: int) -> str:
        b = self.base
        return "".join(self.chars[d - 1] for d in (gram // (b * b), gram // b % b, gram % b) if d)

    def number(self, text: str, place: dict[str, int]) -> int | None:
        digits = [place.get(c, 0) for c in text]
        if not all(digits):
            return None
        digits += [0] * (3 - len(digits))
        return (digits[0] * self.base + digits[1]) * self.base + digits[2]


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    keys = np.sort(keys.astype(np.uint32) if len(keys) and keys.max() < 1 << 32 else keys)
    if not len(keys):
        return keys.astype(np.int64), keys.astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at].astype(np.int64), np.diff(np.append(at, len(keys)))


def _pieces(low: str, size: int = SLICE) -> Iterator[_Grams]:
    """The n-grams of a long text, a piece at a time; pieces overlap by the two letters that may stand before one."""
    for at in range(0, len(low), size):
        counted = min(at, 2)
        yield _Grams([low[at - counted : at + size]], counted, at + size >= len(low))


def _of_long_text(low: str) -> Counter:
    """How often each n-gram occurs in a text of any length."""
    out: Counter = Counter()
    for grams in _pieces(low):
        keys, n = _counted(grams.gram)
        for k, v in zip(keys.tolist(), n.tolist(), strict=True):
            out[grams.text(k)] += v
    return out


def _lowered(batch: pa.RecordBatch) -> list[str]:
    return [(t or "").lower() for t in batch.column("text").to_pylist()]


def _is_long(low: list[str]) -> bool:
    """A text beyond a slice's size is a slice of its own."""
    return len(low) == 1 and len(low[0]) > SLICE


def profiles(labelled: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """lang, gram, rank (from 0): the most frequent n-grams of each language over all rows of labelled (text, lang). Ties go by code point. Rows without text or lang count for nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                langs = batch.column("lang").to_pylist()
                low = _lowered(batch)
                if _is_long(low):
                    counted = _of_long_text(low[0])
                    yield pa.RecordBatch.from_arrays([pa.array(langs * len(counted), pa.string()), pa.array(list(counted), pa.string()), pa.array(list(counted.values()), pa.int64())], ["lang", "gram", "n"])
                    continue
                names = sorted(set(langs))
                place = {l: i for i, l in enumerate(names)}  # noqa: E741
                grams = _Grams(low)
                of = np.array([place[l] for l in langs], np.int64)[grams.doc]  # noqa: E741
                cube = grams.base**3
                keys, n = _counted(of * cube + grams.gram)
                yield pa.RecordBatch.from_arrays([pa.array([names[k // cube] for k in keys.tolist()]), pa.array([grams.text(k % cube) for k in keys.tolist()]), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    prepared(labelled.sparkSession)
    counts = labelled.where("text is not null and lang is not null").select("text", "lang").mapInArrow(run, "lang string, gram string, n long")
    total = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    w = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return total.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < length).select("lang", "gram", "rank")


def _distances(texts: list[str], known: dict[str, dict[str, int]], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Out-of-place distance of each text, in lower case, to each language, and the number of n-grams compared."""
    if _is_long(texts):
        counted = _of_long_text(texts[0])
        own = sorted(counted, key=lambda g: (-counted[g], g))[:length]
        far = [sum(min(abs(i - ranks[g]), length) if g in ranks else length for i, g in enumerate(own)) for ranks in known.values()]
        return np.array([far], float).reshape(1, len(known)), np.array([len(own)])
    grams = _Grams(texts)
    cube = grams.base**3
    keys, n = _counted(grams.doc.astype(np.int64) * cube + grams.gram)
    doc, gram = keys // cube, keys % cube
    # by document, most frequent first, ties by code point
    most, wide = int(n.max(initial=0)) + 1, cube.bit_length()
    if (len(texts) * most << wide) < 1 << 63:
        packed = np.sort(((doc * most + (most - 1 - n)) << wide) | gram)
        doc, gram = (packed >> wide) // most, packed & ((1 << wide) - 1)
    else:
        order = np.lexsort((gram, -n, doc))
        doc, gram = doc[order], gram[order]
    first = np.searchsorted(doc, np.arange(len(texts)))
    rank = np.arange(len(doc)) - first[doc]
    top = rank < length
    doc, gram, rank = doc[top], gram[top], rank[top]
    compared = np.bincount(doc, minlength=len(texts))
    place = {c: i + 1 for i, c in enumerate(grams.chars)}
    out = np.zeros((len(texts), len(known)))
    for j, lang in enumerate(known):
        pairs = sorted((g, r) for t, r in known[lang].items() if (g := grams.number(t, place)) is not None)
        own, ranks = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)
        at = np.searchsorted(own, gram)
        hit = (at < len(own)) & (own[np.minimum(at, max(len(own) - 1, 0))] == gram) if len(own) else np.zeros(len(gram), bool)
        apart = np.full(len(gram), length, np.int64)
        apart[hit] = np.minimum(np.abs(rank[hit] - ranks[at[hit]]), length)
        out[:, j] = np.bincount(doc, weights=apart, minlength=len(texts))
    return out, compared


def predicted(docs: DataFrame, learned: DataFrame, *, length: int = LENGTH, lettered: str | None = None) -> DataFrame:
    """docs with lang_pred and score (0 to 1) in place of text, from profiles(). Columns that docs has under these two names are replaced; all others stay, whatever their names.

    The score is 1 less the distance over the largest possible one. A null
    text, or one without letters, is `und` with score 0, as is every text when
    nothing was learned. Languages at equal distance go by code point. Profiles
    are fetched and broadcast: `length` short rows for each language. With
    `lettered`, a column of that name says whether the text has letters.
    """
    known: dict[str, dict[str, int]] = {}
    for r in learned.orderBy("lang", "rank").collect():
        known.setdefault(r["lang"], {})[r["gram"]] = r["rank"]
    names = sorted(known)
    prepared(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast({k: known[k] for k in names})
    rest = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *([T.StructField(lettered, T.BooleanType())] if lettered else [])]
    schema = T.StructType([*(docs.schema[c] for c in rest), *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                far, compared = _distances(_lowered(batch), sent.value, length)
                some = (compared > 0) & bool(names)
                best = far.argmin(axis=1) if names else np.zeros(len(far), int)
                score = np.zeros(len(far))
                score[some] = 1 - far[some, best[some]] / (length * compared[some])
                lang = [names[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist(), strict=True)]
                more = [pa.array(compared > 0)] if lettered else []
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(lang, pa.string()), pa.array(score), *more], [*rest, "lang_pred", "score", *([lettered] if lettered else [])])

    return docs.select(*rest, "text").mapInArrow(run, schema)


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs.

    Profiles come from the rows whose crc32(doc_id as text) mod 5 isn't 0; the
    others are held out. A null doc_id counts as the empty text (crc32 0, held out).
    Repeated rows are predicted each and learned from each. Languages at equal
    distance go by code point. An empty table gives no rows. Texts of any length
    are counted a piece at a time. Other columns are ignored, whatever their names.
    """
    held = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5) == 0
    learned = written(profiles(docs.where(~held)), "profiles")
    return predicted(docs.select("doc_id", held.alias("held_out"), "text"), learned).select("doc_id", "held_out", "lang_pred", "score")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs that have a language. All columns stay.

    A text without any letter goes, and one that shares no n-gram with any
    profile (score 0). Where nothing was learned, no text can match, and all
    with letters stay.

    A row's columns travel with its text through the prediction, so nothing is joined back.
    """
    held = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5) == 0
    learned = written(profiles(docs.where(~held)), "profiles")
    names = docs.columns
    packed = docs.select(F.struct(*[docs[c] for c in names]).alias("loomspan_row"), F.col("text"))
    out = predicted(packed, learned, lettered="lettered").where("lettered")
    if not learned.isEmpty():
        out = out.where("score > 0")
    return out.select("loomspan_row.*").select(*names)
