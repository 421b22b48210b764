"""Dot products of unit vectors, a block of queries against a block of a corpus.

Queries and corpus are dealt to blocks by hashes of their ids. Each block of the
one meets each of the other under a key of its own, so a task holds two blocks,
whatever the tables' sizes. Within a pair of blocks a matrix product says which
pairs can matter; it adds up in an order of its own (for the k best in single
precision, with room for its error), so the scores of those are then summed again,
component by component, as functions.vector.dot does. Equal vectors therefore have
equal scores, and a score doesn't depend on the blocks.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vector import norm
from ..shipping import ship

#: Queries and rows of a block where a few pairs of it come out, and where all may.
FEW, ALL = (4096, 1 << 14), (1024, 1 << 11)
#: Rows, and components of all its rows, of a block that is sized by the length of its vectors.
ROWS, NUMBERS = 1 << 15, 1 << 21
#: Values of `within` that are dealt together.
BAND = 16
#: Scores that are held at once.
HELD = 1 << 22
#: Scores that are added up together, which a core's cache holds with their products; rows of a ranking that leave a task together.
TILE, GIVEN = 1 << 17, 1 << 17
#: Bytes of the corpus that a task which ranks all of it holds in memory; more lie in a file.
SPOOLED = 1 << 28
#: More than the order of a sum of unit vectors' products changes.
SLACK = 1e-9
#: Rows of which the best one stands for all, where the k best are looked for.
STRIDE = 32

Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The vectors of a list column, which are of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def summed(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Scores of the rows i of q and j of c, added up from the first component to the last."""
    out = np.zeros(len(i))
    for a in range(0, len(i), 1 << 16):
        here = slice(a, a + (1 << 16))
        left, right = q[i[here]].T.copy(), c[j[here]].T.copy()
        for x, y in zip(left, right, strict=True):
            out[here] += x * y
    return out


def _few_copies(c: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows without those that k rows before them, of the same group, are equal to."""
    rows = np.ascontiguousarray(np.column_stack([c, group.astype(float)]))
    kinds = np.unique(rows.view(np.dtype((np.void, rows.shape[1] * 8))).ravel(), return_inverse=True)[1].ravel()
    order = np.argsort(kinds, kind="stable")
    ordered = kinds[order]
    nth = np.arange(len(order)) - np.searchsorted(ordered, ordered)
    return np.sort(order[nth < k])


def _chunks(q: np.ndarray, c: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The first query and the approximate scores of some queries against all of c."""
    step = max(1, HELD // max(1, len(c)))
    for a in range(0, len(q), step):
        yield a, q[a : a + step] @ c.T


def _joined(parts: list[Pairs]) -> Pairs:
    if not parts:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _slack(q: np.ndarray, c: np.ndarray) -> float:
    """More than two products in single precision can be off by together; lengths beyond it are left to double precision."""
    a, b = (max(1.0, np.sqrt(np.fmax.reduce(np.einsum("ij,ij->i", x, x), initial=0.0))) for x in (q, c))
    return 4 * (q.shape[1] + 4) * 2.0**-24 * a * b if max(a, b) < 1e9 else np.inf


def _near(q: np.ndarray, c: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Queries and rows of pairs in single precision, among which are the k best of each query.

    Every STRIDE rows have one best row. The k-th of those is no better than the
    k-th of all rows, so that only rows that reach it can matter.
    """
    near = q @ c.T
    wide = len(c) // STRIDE
    cube, rest = near[:, : STRIDE * wide].reshape(len(q), STRIDE, wide), near[:, STRIDE * wide :]
    top = cube.max(axis=1)
    least = np.partition(top, wide - k, axis=1)[:, wide - k] - np.float32(slack)
    i, at = np.nonzero(~(top < least[:, None]))
    one, nth = np.nonzero(~(cube[i, :, at] < least[i, None]))
    more, last = np.nonzero(~(rest < least[:, None]))
    return np.concatenate([i[one], more]), np.concatenate([nth * wide + at[one], STRIDE * wide + last])


def best(q: np.ndarray, c: np.ndarray, k: int) -> Pairs:
    """Query, row and score of the k best pairs of each query, ties to the earlier row. NaN is above all."""
    keep, parts = _few_copies(c, np.zeros(len(c)), k), []
    c_ = c[keep]
    slack = _slack(q, c_) if len(c_) >= 4 * k * STRIDE else np.inf
    single = [x.astype(np.float32) for x in (q, c_)] if slack < np.inf else []
    step = max(1, HELD // max(1, len(c_)))
    for a in range(0, len(q), step):
        some = q[a : a + step]
        i, j = _near(single[0][a : a + step], single[1], k, slack) if single else (None, None)
        if i is None or len(i) > 8 * k * len(some):  # single precision can't tell that many apart
            near = some @ c_.T
            if len(keep) > k:
                least = np.partition(near, len(keep) - k, axis=1)[:, len(keep) - k] - SLACK
                i, j = np.nonzero(~(near < least[:, None]))
            else:
                i, j = np.nonzero(np.ones(near.shape, bool))
        parts.append(_cut((i + a, keep[j], summed(q, c_, i + a, j)), k))
    return _joined(parts)


def reaching(q: np.ndarray, c: np.ndarray, least: float) -> Pairs:
    """Query, row and score of the pairs that reach a score."""
    parts = []
    for a, near in _chunks(q, c):
        i, j = np.nonzero(~(near < least - SLACK))
        s = summed(q, c, i + a, j)
        good = ~(s < least)
        parts.append((i[good] + a, j[good], s[good]))
    return _joined(parts)


def every(q: np.ndarray, c: np.ndarray) -> Pairs:
    """Query, row and score of all pairs."""
    i, j = np.divmod(np.arange(len(q) * len(c)), max(1, len(c)))
    s = np.zeros((len(q), len(c)))
    step = max(1, (1 << 17) // max(1, len(c)))
    left, right = q.T.copy(), c.T.copy()
    for a in range(0, len(q), step):
        for x, y in zip(left, right, strict=True):
            s[a : a + step] += x[a : a + step, None] * y
    return i, j, s.ravel()


def highest(q: np.ndarray, c: np.ndarray, group: np.ndarray) -> Pairs:
    """Query, group and the best score of its rows; groups are numbered from 0, and each has a row."""
    keep = _few_copies(c, group, 1)
    keep = keep[np.argsort(group[keep], kind="stable")]
    c_, own, parts = c[keep], group[keep], []
    starts = np.searchsorted(own, np.arange(own[-1] + 1)) if len(own) else np.zeros(0, int)
    for a, near in _chunks(q, c_):
        top = np.maximum.reduceat(near, starts, axis=1)
        i, j = np.nonzero(~(near < top[:, own] - SLACK))
        s, at = summed(q, c_, i + a, j), i * len(starts) + own[j]
        first = np.flatnonzero(np.diff(at, prepend=-1))  # by query, then by group
        i, g = np.divmod(at[first], len(starts))
        parts.append((i + a, g, np.maximum.reduceat(s, first)))
    return _joined(parts)


def _places(ids: pa.ChunkedArray) -> np.ndarray:
    return pc.sort_indices(ids).to_numpy()


def _cut(pairs: Pairs, k: int) -> Pairs:
    """The k best pairs of each query, ties to the earlier row."""
    i, j, s = pairs
    order = np.lexsort((j, -s, ~np.isnan(s), i))
    i, j, s = i[order], j[order], s[order]
    good = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[good], j[good], s[good]


def sized(dims: int, most: tuple[int, int] = (ROWS, ROWS)) -> tuple[int, int]:
    """Queries and rows of a block of vectors of at most `dims` components."""
    rows = max(1, NUMBERS // max(1, dims))
    return min(most[0], rows), min(most[1], rows)


def _largest(df: DataFrame, by: Sequence[str]) -> tuple[int, int]:
    """Rows of the largest group, and how many groups there are; blocks are within a group."""
    if not by:
        return df.count(), 1
    row = df.groupBy(*by).agg(F.count("*").alias("n__")).agg(F.max("n__"), F.count("*")).first()
    return row[0] or 0, row[1]


def met(
    queries: DataFrame,
    corpus: DataFrame,
    *,
    k: int | None = None,
    least: float | None = None,
    top: bool = False,
    others: bool = False,
    by: Sequence[str] = (),
    within: str | None = None,
    bands: Sequence[int] = (),
    size: tuple[int, int] = FEW,
) -> DataFrame:
    """by, query_id, doc_id, score of queries (by, query_id, q) against corpus (by, doc_id, c), where q and c are unit vectors; null vectors and vectors of unequal lengths don't meet.

    With k the pairs among which are each query's k best, ties to the smaller
    doc_id (of each pair of blocks: rank them again); with `least` all that
    reach a score; with `top` the best one of each doc_id and pair of blocks,
    where doc_ids repeat; otherwise all. others: no query meets the row that
    has its id. within: a column of corpus, an integer from 0, whose values
    each query has in an array `within`; it meets no other rows. bands: how many
    rows each BAND of those values has. size: queries and rows of a block at most.
    """
    spark = queries.sparkSession
    ship(spark)
    q, c = queries.withColumn("dims__", F.size("q")), corpus.withColumn("dims__", F.size("c"))
    round_, span = size if k is not None or top else (min(x) for x in zip(size, ALL, strict=True))
    asked, groups = _largest(queries, by)
    down = max(1, -(-asked // round_))
    blocks = lambda n: F.sequence(F.lit(0), n - 1)
    # null vectors are dealt to no block; a filter would bring a vector to unit length once more
    dealt = lambda vector, places: F.explode(F.when(F.col(vector).isNotNull(), places))
    deal = lambda column, n: F.pmod(F.xxhash64(column), n).cast("int")
    # the rows that are alike in what they are dealt by go to one block
    own = "part__" if "part__" in corpus.columns else "doc_id"
    if within is None:
        rows = _largest(corpus, by)[0]
        # twice as many pairs of blocks as there are cores, where rows suffice
        across = F.lit(max(1, -(-rows // span), min(-(-2 * spark.sparkContext.defaultParallelism // (down * max(1, groups))), rows // 256)))
        c = c.withColumn("across__", deal(own, across)).withColumn("piece__", F.lit(0))
        q = q.withColumn("across__", dealt("q", blocks(across))).withColumn("piece__", F.lit(0))
    else:
        # a band is a block or more, and only bands that a query has are sent it
        pieces = F.array(*[F.lit(max(1, -(-n // span))) for n in bands])
        band = lambda x: F.floor(x / BAND).cast("int")
        c = c.withColumn("across__", band(F.col(within))).withColumn("piece__", deal(own, F.get(pieces, "across__")))
        q = q.withColumn("across__", dealt("q", F.array_distinct(F.transform("within", band)))).withColumn("piece__", F.explode(blocks(F.get(pieces, "across__"))))
    keys = [*by, "dims__", "across__", "piece__", "down__"]
    q = q.withColumn("down__", deal("query_id", F.lit(down)))
    c = c.withColumn("down__", dealt("c", blocks(F.lit(down)))).drop("part__")
    kind = T.StructType([*[queries.schema[b] for b in by], queries.schema["query_id"], corpus.schema["doc_id"], T.StructField("score", T.DoubleType())])
    return q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(_finder(k, least, top, others, by, within), kind)


def _finder(k: int | None, least: float | None, top: bool, others: bool, by: Sequence[str], within: str | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def found(q: np.ndarray, c: np.ndarray) -> Pairs:
        if k is not None:
            return best(q, c, k + others)
        return every(q, c) if least is None else reaching(q, c, least)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        mine, theirs = left["query_id"], right["doc_id"]
        names = [*by, "query_id", "doc_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([*[left[b].slice(0, 0) for b in by], mine.slice(0, 0), theirs.slice(0, 0), pa.array([], pa.float64())], names)
        if k is not None:  # rows in order of their ids
            right = right.take(pa.array(_places(theirs)))
            theirs = right["doc_id"]
        q, c = matrix(left["q"]), matrix(right["c"])
        if top:
            coded = theirs.combine_chunks().dictionary_encode(null_encoding="encode")
            i, j, s = highest(q, c, coded.indices.to_numpy())
            theirs = coded.dictionary
        elif within is None:
            i, j, s = found(q, c)
        else:
            own, lists = right[within].to_numpy(), left["within"].combine_chunks()
            asks, wanted = pc.list_parent_indices(lists).to_numpy(), lists.flatten().to_numpy(zero_copy_only=False)
            parts = []
            for w in np.unique(own):
                some, rows = asks[wanted == w], np.flatnonzero(own == w)
                a, b, s = found(q[some], c[rows])
                parts.append((some[a], rows[b], s))
            i, j, s = _joined(parts)
        if others:
            alike = pc.equal(mine.take(pa.array(i)), theirs.take(pa.array(j))).to_numpy(zero_copy_only=False)
            i, j, s = (x[~alike.astype(bool)] for x in (i, j, s))
        if k is not None:
            i, j, s = _cut((i, j, s), k)
        at, to = pa.array(i), pa.array(j)
        return pa.table([*[left[b].take(at) for b in by], mine.take(at), theirs.take(to), pa.array(s)], names)

    return run


class _Held:
    """Vectors of one length, which a task reads again and again: ids and lengths in memory, components in a file of the task beyond SPOOLED bytes."""

    def __init__(self) -> None:
        place = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        self._file = tempfile.SpooledTemporaryFile(max_size=SPOOLED, dir=place if os.path.isdir(place) else None)
        self._ids, self._lengths = [], []

    def add(self, ids: pa.Array, lengths: np.ndarray, vectors: np.ndarray) -> None:
        self._file.seek(0, os.SEEK_END)
        self._file.write(np.ascontiguousarray(vectors).data)
        self._ids.append(ids)
        self._lengths.append(lengths)
        self._kind, self._dims = vectors.dtype, vectors.shape[1]

    def done(self) -> None:
        """What add() gave is all: ids are brought in order, null ids before others."""
        ids, self.n = pa.concat_arrays(self._ids), np.concatenate(self._lengths)
        self.order = pc.array_sort_indices(ids, null_placement="at_start").to_numpy()
        self.ids = ids.take(pa.array(self.order))
        self._ids = self._lengths = []

    def scores(self, q: np.ndarray) -> np.ndarray:
        """Scores of the unit vectors q against all, as they came, added up from the first component to the last."""
        out, step = np.empty((len(q), len(self.n))), max(1, TILE // len(q))
        self._file.seek(0)
        for a in range(0, len(self.n), step):
            n = self.n[a : a + step]
            raw = np.frombuffer(self._file.read(len(n) * self._dims * self._kind.itemsize), self._kind).reshape(len(n), self._dims)
            unit, s = (raw.astype(float) / n[:, None]).T.copy(), np.zeros((len(q), len(n)))
            one = np.empty_like(s)
            for x, y in zip(q.T, unit, strict=True):
                np.multiply(x[:, None], y, out=one)
                s += one
            out[:, a : a + step] = s
        return out


def _downward(s: np.ndarray) -> np.ndarray:
    """Places in order of scores that come in order of ids, best first, as Spark orders them: NaN above all, ties to the smaller id."""
    down = np.where(np.isnan(s), -np.inf, -s)
    order = np.argsort(down)
    ordered = down[order]
    new = ordered[1:] != ordered[:-1]
    if np.all(new):
        return order
    # the places of equal scores follow one another: sorted with the number of their score before them, they are in order
    before = np.concatenate([[0], np.cumsum(new)]) * len(s)
    return np.sort(before + order) - before


def _asked(queries: dict[int, tuple[pa.Array, np.ndarray]], held: dict[int, _Held]) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """Id of a query as an array of one, ids and their scores, in order of ids. Queries that share an id have one ranking."""
    codes = pa.concat_arrays([ids for ids, _ in queries.values()]).dictionary_encode(null_encoding="encode").indices.to_numpy()
    twice, met, at = np.bincount(codes) > 1, {}, 0
    for dims, (ids, q) in queries.items():
        own = codes[at : at + len(ids)]
        at += len(ids)
        if dims not in held:
            continue
        there = held[dims]
        step = max(1, 2 * HELD // len(there.n))
        for a in range(0, len(q), step):
            for i, s in enumerate(there.scores(q[a : a + step]), a):
                one = ids.slice(i, 1), there.ids, s[there.order]
                if not twice[own[i]]:
                    yield one
                else:
                    met.setdefault(own[i], []).append(one)
    for parts in met.values():
        docs, s = pa.concat_arrays([d for _, d, _ in parts]), np.concatenate([s for _, _, s in parts])
        order = pc.array_sort_indices(docs, null_placement="at_start")
        yield parts[0][0], docs.take(order), s[order.to_numpy()]


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole rankings of the queries among the rows, against the others; see rankings()."""
    asked, held = {}, {}
    for batch in batches:
        vectors, n = batch.column("v__"), batch.column("n__").to_numpy()
        asks, dims = batch.column("asks__").to_numpy(zero_copy_only=False), pc.list_value_length(vectors).to_numpy()
        for d in np.unique(dims).tolist():
            for query in np.unique(asks[dims == d]).tolist():
                at = np.flatnonzero((dims == d) & (asks == query))
                place = pa.array(at)
                ids, own = batch.column("query_id" if query else "doc_id").take(place), matrix(vectors.take(place))
                if query:
                    asked.setdefault(d, []).append((ids, own.astype(float) / n[at, None]))
                else:
                    held.setdefault(d, _Held()).add(ids, n[at], own)
    for rows in held.values():
        rows.done()
    queries = {d: (pa.concat_arrays([i for i, _ in parts]), np.concatenate([q for _, q in parts])) for d, parts in asked.items()}
    ready, size = [], 0
    for query, ids, s in _asked(queries, held) if queries else ():
        order = _downward(s)
        for a in range(0, len(order), GIVEN):
            some = order[a : a + GIVEN]
            rank = np.arange(a + 1, a + len(some) + 1, dtype=np.int32)
            ready.append((query.take(pa.array(np.zeros(len(some), int))), pa.array(rank), ids.take(pa.array(some)), pa.array(s[some])))
            size += len(some)
            if size >= GIVEN:
                yield _batch(ready)
                ready, size = [], 0
    if ready:
        yield _batch(ready)


def _batch(parts: list[tuple[pa.Array, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*parts, strict=True)], ["query_id", "rank", "doc_id", "score"])


def rankings(queries: DataFrame, corpus: DataFrame, most: int = FEW[0]) -> DataFrame:
    """query_id, rank, doc_id, score of every query (query_id, embedding) against every row (doc_id, embedding), best first, ties to the smaller doc_id; zero vectors and null ones take no part.

    Queries are dealt to blocks, of at most `most` and as many as there are
    cores; each is sent the corpus, once, as it came and with its vectors'
    lengths. A task ranks a few queries at a time and hands them on, so no score is
    shuffled: what is, is the corpus times the blocks, not the pairs. Memory
    holds an id and two numbers for each row, and the scores of those queries.
    """
    spark = queries.sparkSession
    ship(spark)
    asked = queries.count()
    down = max(1, -(-asked // most), min(spark.sparkContext.defaultParallelism, asked))
    places = lambda x: F.explode(F.when(F.col("n__") > 0, x))
    deal = lambda df, key: df.select(key, F.col("embedding").alias("v__"), norm(F.col("embedding")).alias("n__"), F.lit(key == "query_id").alias("asks__"))
    own = F.array(F.pmod(F.xxhash64("query_id"), F.lit(down)).cast("int"))
    q = deal(queries, "query_id").withColumn("down__", places(own))
    c = deal(corpus, "doc_id").withColumn("down__", places(F.sequence(F.lit(0), F.lit(down - 1))))
    kind = T.StructType([queries.schema["query_id"], T.StructField("rank", T.IntegerType()), corpus.schema["doc_id"], T.StructField("score", T.DoubleType())])
    both = q.unionByName(c, allowMissingColumns=True)
    return both.repartitionById(down, F.col("down__")).groupBy("down__").applyInArrow(_ranked, kind)
