"""SimHash near-duplicates, candidates found by the pigeonring principle.

A 64-bit fingerprint is a ring of four 16-bit segments. If two differ in at
most three bits, some segment starts a chain whose first l segments together
differ in at most 3 l / 4 bits, for every l: 0, 1, 2, then 3. So the first is
equal; of the two halves of the second at least one is equal; and of the four
halves of the second and third at least two, one of them in the second. The
five pairs of halves that remain, with the first segment, are the join keys:
20 for each fingerprint, of 32 bits each. Candidates must pass the whole chain
before their Hamming distance is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepared, slices, text_bytes, written
from .components import components

#: Fixed values of the contract.
SHINGLE, SEED, DISTANCE = 3, 42, 3
SEGMENTS, SEGMENT_BITS = 4, 16
HALVES = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3))
#: Fingerprints that are compared with one another in one piece; a larger group is cut into blocks of this size.
BLOCK = 2000


def _hashes(words: list[bytes]) -> bytes:
    """The shingles' hashes as big-endian bytes. Shingles are slices of the space-joined words."""
    digest = xxhash.xxh64_digest
    if len(words) < SHINGLE:
        return digest(b" ".join(words), SEED) if words else b""
    joined = b" ".join(words)
    ends = list(accumulate([len(w) + 1 for w in words]))
    return b"".join([digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[SHINGLE - 1 :], strict=False)])


def _fingerprint(hashes: np.ndarray) -> np.uint64:
    """hashes: a row of 8 bytes for each shingle. A bit is 1 if it is set in over half of them."""
    if not len(hashes):
        return np.uint64(0)
    ones = np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes)).view(">u8")[0].astype(np.uint64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp of each row; the fingerprint's 64 bits as a signed integer. Null and blank texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                fps = [_fingerprint(np.frombuffer(_hashes(t.lower().split()), np.uint8).reshape(-1, 8)) for t in text_bytes(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    prepared(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _keys():
    """Array of the 20 join keys of column fp: which chain and halves in the high bits, 32 bits of the fingerprint in the low ones."""
    part = lambda at, bits: F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << bits) - 1))
    out = []
    for i in range(SEGMENTS):
        first = part(i * SEGMENT_BITS, SEGMENT_BITS)
        half = [part(((i + 1 + h // 2) % SEGMENTS) * SEGMENT_BITS + 8 * (h % 2), 8) for h in range(4)]
        for k, (a, b) in enumerate(HALVES):
            out.append(F.lit((i * len(HALVES) + k) << 32) + F.shiftleft(first, 16) + F.shiftleft(half[a], 8) + half[b])
    return F.array(*out)


def _linked(a: np.ndarray, b: np.ndarray, chain: int) -> np.ndarray:
    """Which pairs of a (rows) and b (columns) link: the chain from its first segment on, then all bits."""
    x = a[:, None] ^ b[None, :]
    mask, total = np.uint64((1 << SEGMENT_BITS) - 1), np.zeros(x.shape, np.uint8)
    ok = np.ones(x.shape, bool)
    for l in range(SEGMENTS - 1):  # noqa: E741
        at = np.uint64(((chain + l) % SEGMENTS) * SEGMENT_BITS)
        total += np.bitwise_count((x >> at) & mask)
        ok &= total <= (l + 1) * DISTANCE // SEGMENTS
    return ok & (np.bitwise_count(x) <= DISTANCE)


def _passes(x: int, chain: int) -> bool:
    """_linked() for the differing bits of one pair, which is by far the most frequent group."""
    total = 0
    for l in range(SEGMENTS - 1):  # noqa: E741
        total += (x >> ((chain + l) % SEGMENTS * SEGMENT_BITS) & ((1 << SEGMENT_BITS) - 1)).bit_count()
        if total > (l + 1) * DISTANCE // SEGMENTS:
            return False
    return x.bit_count() <= DISTANCE


def _forest(fp: np.ndarray, chain: int) -> list[tuple[int, int]]:
    """Edges (larger, smaller) that connect what links in fp, fewer than there are fingerprints. fp is sorted as signed integers."""
    n = len(fp)
    u = fp.view(np.uint64)
    label = np.arange(n)
    while True:
        new = label.copy()
        for at in range(0, n, 256):
            near = np.where(_linked(u[at : at + 256], u, chain), label[None, :], n).min(axis=1)
            new[at : at + 256] = np.minimum(new[at : at + 256], near)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(int(fp[i]), int(fp[j])) for i, j in enumerate(label) if i != j]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, cell, fp), sorted: the edges of each (key, cell), which has at most twice BLOCK fingerprints or so."""
    held: tuple | None = None
    rows: list[np.ndarray] = []

    def flush() -> list[tuple[int, int]]:
        if held is None:
            return []
        fp = np.unique(np.concatenate(rows))
        if len(fp) == 2:
            a, b = int(fp[0]), int(fp[1])
            return [(b, a)] if _passes((a ^ b) & (2**64 - 1), (held[0] >> 32) // len(HALVES)) else []
        return _forest(fp, (held[0] >> 32) // len(HALVES)) if len(fp) > 2 else []

    def packed(edges: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["u", "v"])

    for batch in batches:
        if not len(batch):
            continue
        key, cell, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "cell", "fp"))
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1).tolist(), len(key)]
        edges: list[tuple[int, int]] = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            group = (int(key[a]), int(cell[a]))
            if group != held:
                edges += flush()
                held, rows = group, []
            rows.append(fp[a:b])
        yield packed(edges)
    yield packed(flush())


def links(distinct: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, that connect the fingerprints in column fp just as all links do.

    A key shared by more than BLOCK fingerprints is cut into blocks by hash;
    every two blocks meet in a cell of their own, so no task gets the group.
    """
    keyed = distinct.select("fp", F.explode(_keys()).alias("key"))
    n = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    hot = n.where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    hot = written(hot, "hot")
    if hot.count() == 0:
        cells = keyed.withColumn("cell", F.lit(0).cast("long"))
    else:
        own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        grid = keyed.join(hot, "key").select("key", "fp", own.alias("own"), "blocks", other)
        grid = grid.select("key", (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).cast("long").alias("cell"), "fp")
        cells = keyed.join(hot, "key", "left_anti").select("key", F.lit(0).cast("long").alias("cell"), "fp").unionByName(grid)
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.select("key", "cell", "fp").repartition(parts, "key", "cell").sortWithinPartitions("key", "cell", "fp")
    return dealt.mapInArrow(_pairs, "u long, v long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, fingerprint (16 hex digits), component_id of each row of docs.

    Equal fingerprints are one node, so copies cost nothing. component_id is
    the smallest doc_id that links reach, its own included; null ids don't
    count, and a component without any other id has a null one. Null and blank
    texts share fingerprint zero and link like any other. Repeated rows stay,
    texts may have any length, and an empty table gives no rows. Other columns
    are ignored, whatever their names.
    """
    rows = written(fingerprints(docs), "fps")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(links(nodes.select("fp")))
    rooted = nodes.join(found, nodes.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(rooted.join(smallest, "root").select(F.col("fp").alias("node"), "component_id"), "named")
    return rows.join(named, rows.fp == named.node, "left").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is their component's smallest, with all columns. Ids should be unique; where rows share one, all of them stay. Where a component has null ids only, all its rows stay, since none can be named."""
    found = near_duplicates(docs).where("doc_id <> component_id or (doc_id is null and component_id is not null)").select(F.col("doc_id").alias("loomspan_gone")).distinct()
    return docs.join(found, docs.doc_id.eqNullSafe(found.loomspan_gone), "left_anti")
