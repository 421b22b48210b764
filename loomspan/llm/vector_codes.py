"""Codes for vectors: each part's nearest codebook entry, found behind segment-mean lower bounds.

A vector is cut into parts, each with a codebook of its own that a few rounds
of assignment and averaging fit to all rows. The distance of two parts is at
least what their segments' means and residual norms are apart: a segment of
length L with sums s, t and residual norms r, u adds (s - t)^2 / L + (r - u)^2
or more. The bound is taken coarse to fine, with one segment for the whole part
and then with shorter ones; entries whose bound exceeds the exact distance of
an entry that is known already go. Bounds are lowered by more than rounding can
add, so none goes wrongly, and all that is left is compared in integers.

Rows are independent: a round is one pass that sends a sum for each entry and
task, and the codebooks, whose size is a parameter, are all that is fetched and
broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepared, written

#: Parts of a vector, entries of a codebook, rounds of fitting, and what a component is multiplied by before it is floored.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Segments of a part, coarse to fine.
SEGMENTS = (1, 4)
#: Below this size of components, in parts of up to WIDEST, all sums and squares are exact in 64 bits.
SAFE, WIDEST = 1 << 20, 2048
#: Rows that are compared with a codebook at once.
BLOCK = 1024


def whole_numbers(flat: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite doubles: 64-bit where all are small, else Python integers. scale is a power of two."""
    with np.errstate(over="ignore"):
        scaled = np.floor(flat * scale)
    if not len(flat) or np.abs(scaled).max() < SAFE:
        return scaled.astype(np.int64)
    return np.array([int(s) if np.isfinite(s) else int(x) * scale for s, x in zip(scaled.tolist(), flat.tolist(), strict=True)], object)


class Codebook:
    """The entries of one part, with their segments' sums and residual norms."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        width = entries.shape[1]
        self.cuts = [np.unique(np.linspace(0, width, n + 1).astype(int)) for n in SEGMENTS] if width else []
        self.fits = entries.dtype != object and width <= WIDEST
        self.seen = self.left = 0  # pairs of a part and an entry, and those that exact distances were taken of
        if self.fits:
            self.segments = [_segments(entries, cut) for cut in self.cuts]
            self.energy = float((entries * entries).sum(axis=1).max(initial=0))

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row, the lower on ties, and its squared distance."""
        if not self.fits or parts.dtype == object:  # beyond 64 bits bounds in doubles are no help
            rows = [((x - self.entries.astype(object)) ** 2).sum(axis=1) for x in parts.astype(object)]
            index = np.array([min(range(len(d)), key=d.__getitem__) for d in rows], np.int64)
            return index, np.array([d[i] for d, i in zip(rows, index, strict=True)], object)
        done = [self._block(parts[i : i + BLOCK]) for i in range(0, len(parts), BLOCK)] or [(np.zeros(0, np.int64),) * 2]
        return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])

    def _block(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, k = len(x), len(self.entries)
        self.seen += n * k
        slack = 1e-9 * ((x * x).sum(axis=1) + self.energy) + 1e-6
        least = np.full(n, np.iinfo(np.int64).max)
        row = entry = None
        for cut, (sums, norms) in zip(self.cuts, self.segments, strict=True):
            own_sums, own_norms = _segments(x, cut)
            size = np.diff(cut).astype(float)
            if row is None:
                bound = sum((own_sums[:, [j]] - sums[None, :, j]) ** 2 / size[j] + (own_norms[:, [j]] - norms[None, :, j]) ** 2 for j in range(len(size)))
                first = bound.argmin(axis=1)
            else:
                bound = np.zeros(len(row))
                for j in range(len(size)):
                    bound += (own_sums[row, j] - sums[entry, j]) ** 2 / size[j] + (own_norms[row, j] - norms[entry, j]) ** 2
                starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                lowest = np.minimum.reduceat(bound, starts)
                at = np.flatnonzero(bound == lowest[row])
                first = entry[at[np.r_[True, row[at[1:]] != row[at[:-1]]]]]
            # the entry with the lowest bound gives an exact distance that all others must undercut
            gap = x - self.entries[first]
            least = np.minimum(least, (gap * gap).sum(axis=1))
            if row is None:
                row, entry = np.nonzero(bound - slack[:, None] <= least[:, None])
            else:
                keep = bound - slack[row] <= least[row]
                row, entry = row[keep], entry[keep]
        self.left += len(row)
        gap = x[row] - self.entries[entry]
        exact = (gap * gap).sum(axis=1)
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        least = np.minimum.reduceat(exact, starts)
        at = np.flatnonzero(exact == least[row])
        return entry[at[np.r_[True, row[at[1:]] != row[at[:-1]]]]], least


def _segments(x: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and residual norms of the segments of each row; what goes below the root is a whole number."""
    sums = np.add.reduceat(x, cut[:-1], axis=1)
    squares = np.add.reduceat(x * x, cut[:-1], axis=1)
    size = np.diff(cut)
    return sums.astype(float), np.sqrt((size * squares - sums * sums) / size)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _assigned(column: pa.Array, books: list[Codebook], scale: int):
    """For each part position: the rows' parts, their entries and squared distances."""
    width = sum(b.entries.shape[1] for b in books)
    matrix = whole_numbers(_matrix(column, width).reshape(-1), scale).reshape(len(column), width)
    for book, part in zip(books, np.split(matrix, len(books), axis=1), strict=True):
        yield part, *book.nearest(part)


def usable(column: str = "embedding") -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(False))


class Codes:
    """Fitted codebooks and the rows they were fitted to: `books`, `rows`."""

    def __init__(self, vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> None:
        spark = vectors.sparkSession
        prepared(spark)
        self.parts, self.scale = parts, scale
        kept = vectors.where(usable()).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
        first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
        self.width = len(first[0]["embedding"]) if first else 0
        if self.width % parts:
            raise ValueError(f"vectors of {self.width} components can't be cut into {parts} equal parts")
        self.rows = written(kept.where(F.size("embedding") == self.width), "vectors")
        start = [r["embedding"] for r in first if len(r["embedding"]) == self.width]
        start = whole_numbers(np.array(start, float).reshape(-1), scale).reshape(len(start), self.width)
        self.books = [Codebook(b) for b in np.split(start, parts, axis=1)] if self.width else []
        for _ in range(rounds if self.width else 0):
            self.books = self._moved()

    def _moved(self) -> list[Codebook]:
        """Each entry becomes the floored mean of the parts assigned to it."""
        shared, scale = self.rows.sparkSession.sparkContext.broadcast(self.books), self.scale

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books = shared.value
            sums = [np.zeros(b.entries.shape, object) for b in books]
            sizes = [np.zeros(len(b.entries), np.int64) for b in books]
            for batch in batches:
                for p, (part, index, _) in enumerate(_assigned(batch.column("embedding"), books, scale)):
                    own = np.zeros(sums[p].shape, part.dtype)
                    np.add.at(own, index, part)
                    sums[p] += own
                    sizes[p] += np.bincount(index, minlength=len(sizes[p]))
            rows = [(p, e, int(n), [str(v) for v in sums[p][e]]) for p, size in enumerate(sizes) for e, n in enumerate(size) if n]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.list_(pa.string()))], ["part", "entry", "n", "sums"])

        found = self.rows.select("embedding").mapInArrow(run, "part int, entry int, n long, sums array<string>").repartition("part", "entry")
        each = found.select("part", "entry", "n", F.posexplode("sums").alias("place", "v"))
        mean = each.groupBy("part", "entry", "place").agg(F.sum(F.col("v").cast("decimal(38,0)")).cast("string").alias("s"), F.sum("n").alias("n"))
        moved = [b.entries.astype(object) for b in self.books]
        for r in mean.collect():  # parts x entries x width numbers
            moved[r["part"]][r["entry"]][r["place"]] = int(r["s"]) // r["n"]
        shared.destroy()
        small = all(abs(v) < SAFE for m in moved for v in m.flat)
        return [Codebook(m.astype(np.int64) if small else m) for m in moved]

    def digest(self) -> str:
        """SHA-256 of all entries' components, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(v) for b in self.books for v in b.entries.reshape(-1).tolist()).encode()).hexdigest()

    def coded(self) -> DataFrame:
        """vec_id, label, code (entry of each part), error (squared distance in all) of each row."""
        if not self.width:
            return self.rows.select("vec_id", "label", F.array().cast("array<int>").alias("code"), F.lit(0).cast("long").alias("error"))
        shared, scale = self.rows.sparkSession.sparkContext.broadcast(self.books), self.scale

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes, errors = [], 0
                for _, index, error in _assigned(batch.column("embedding"), shared.value, scale):
                    codes.append(index.tolist())
                    errors = errors + error
                code = pa.array([list(c) for c in zip(*codes, strict=True)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), code, pa.array([int(e) for e in errors], pa.int64())], ["vec_id", "label", "code", "error"])

        own = [self.rows.schema[c] for c in ("vec_id", "label")]
        return self.rows.mapInArrow(run, T.StructType([*own, T.StructField("code", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())]))


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of the vectors' columns vec_id, embedding, label.

    Components count as floor(scale x). Codebooks begin with the parts of the
    `entries` smallest vec_ids, ties by the vector and nulls last; there are
    fewer where the table has fewer rows. In each round all parts go to their
    nearest entry, and entries become the floored mean of their parts; unused
    ones stay. code has the entries of the last assignment, error its squared
    distances, label_error their sum over rows of one label (null is a label).
    Codes has the codebooks themselves.

    Vectors that are null or have null or non-finite components take no part,
    nor do vectors of another length than that of the smallest vec_id. That
    length must be a multiple of `parts`: else it is an error, as are an error
    sum beyond 64 bits and a component's sum beyond 38 digits. Rows that repeat an id or are alike altogether are coded
    each. An empty table gives no rows. Other columns are ignored.
    """
    codes = Codes(vectors, parts, entries, rounds, scale)
    rows = written(codes.coded(), "codes")
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = rows.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))
