"""Token ids in binary shards, with a minimal perfect hash index for keyed access.

A store is a folder of three Parquet tables, so that Spark's committer and any
file system serve it:

* blocks: shard, block, n_ids, docs and lengths of the documents in it, and
  payload, their ids one after another as raw little-endian 16- or 32-bit
  integers. Shards hold ranges of doc_id in ascending order, null ids last; an
  id, or null, with more documents than a shard has SUBS of them, by the first
  byte of the payload.
* index: for each bucket of keys the levels of a minimal perfect hash, with the
  number of bits before each word of them, and for each of its slots a 32-bit fingerprint and the shard, block, offset and
  length that a key of this slot has. Keys themselves aren't stored.
* starts: ids before each block.

A key is a document's id and its place among documents of the same id. It is
looked up in constant time: its bucket, the first level whose bit it has, the
rank of that bit, the fingerprint, the entry.
"""

from __future__ import annotations

import json
import os
import re
import string
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.running import sums_before
from .bpe import _byte_letters, default_path
from .common import BLANKS, prepared, slices, text_bytes, written

END = 2  # appended to each document
BLOCK_BYTES = 64 << 10
ROW_GROUP = 16 << 20  # bytes that a writer of payloads holds
KEYS = 4096  # in a bucket of the index, on average
#: Keys of a level go to twice as many bits; those that share a bit go on to the next level.
SPREAD = 2
#: Bytes of text of a shard, on average, and shards of an id that is repeated more often than a shard has documents.
SHARD_BYTES, SUBS = 32 << 20, 256
#: Blocks that a request can touch for the others to be skipped by a broadcast of their numbers.
FEW = 100_000


def _by_word(spec: dict) -> tuple[bool, bool]:
    """Whether a tokenizer drops white space before anything looks beyond a word, and whether it lower-cases."""
    normal = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    drops = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True
    return drops and set(normal) <= {"NFC", "Replace", "Lowercase"}, "Lowercase" in normal


#: Punctuation that, after letters, is split from a word; an apostrophe may belong to a contraction.
_TAIL = string.punctuation.replace("'", "")
#: Bytes of text that are encoded together, and bytes of a cache of words, with what a dictionary needs for each entry.
SLICE, CACHE, ENTRY = 6 << 20, 24 << 20, 160
#: Words that are asked for in one text, and pieces of letters that each half of their cache has at most.
ASKED, PIECES = 2000, 100_000
#: Fixed value: the split pattern by which letters, and other characters but digits, that stand together are one piece each.
_LETTERS_ALONE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters in lower case that normalisation leaves alone.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")


def _by_piece(spec: dict) -> bool:
    """Whether a run of plain letters is one piece of the model's, whatever stands around it."""
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = parts[0].get("pattern", {}).get("Regex") if parts else None
    return split == _LETTERS_ALONE and [p.get("type") for p in parts[1:]] == ["ByteLevel"] and not parts[1].get("add_prefix_space", True) and not parts[1].get("use_regex", True)


def _words(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word in texts laid end to end, and how many words each text has. A word ends at one of the six ASCII blanks or with its text."""
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    new = solid.copy()
    new[1:] &= ~solid[:-1]
    at = begin[:-1][begin[:-1] < len(data)]
    new[at] = solid[at]
    first = np.flatnonzero(new)
    upto = np.searchsorted(first, begin)
    return first, np.diff(upto)


class _Ids:
    """Whole-document encoding by the tokenizers library.

    Where the tokenizer drops white space and looks at nothing beyond a word,
    a document's ids are its words' ids, and the library is asked for distinct
    words. Where a run of letters is a piece of its own, the model is asked for
    the plain letters of a word, and for what punctuation ends it. Other words of
    letters, or of letters and closing punctuation, are asked for in one text: a number of word ends in its ids that is the least
    possible one tells that each word has just its own. Other words, and words
    of a text where the number is greater, are asked for one by one. Other
    tokenizers get whole documents.

    The cache has an older and a newer half; a full newer one takes the place
    of the older. Together they hold CACHE bytes at most, and one slice's words.
    """

    def __init__(self, spec: str, width: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.by_word, self.lower = _by_word(json.loads(spec))
        self.marks = re.compile(b"|".join(re.escape(t["content"][:2].encode()) for t in json.loads(spec).get("added_tokens", [])) or b"(?!)")
        self.tokenizer, self.width, self.kind = Tokenizer.from_str(spec), width, {"<u2": "H", "<u4": "I"}[width]
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        suffix = json.loads(spec)["model"].get("end_of_word_suffix") or ""
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
        self.model = self.tokenizer.model if self.by_word and self.lower and _by_piece(json.loads(spec)) else None
        self.letters = {b: c for b, c in _byte_letters().items() if b > 127}
        self.pieces: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}
        self.tails: dict[str, bytes] = {}
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.size = 0

    def _each(self, texts: list[str]) -> list[bytes]:
        return [array(self.kind, e.ids).tobytes() for a in range(0, len(texts), ASKED) for e in self.tokenizer.encode_batch_fast(texts[a : a + ASKED], add_special_tokens=False)]

    def _learned(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of new words."""
        if not words:
            return {}
        texts = b" ".join(words).decode().split(" ")
        least = [1 if t.isalpha() else 2 if t.rstrip(_TAIL).isalpha() and not self.marks.search(w) else 0 for t, w in zip(texts, words, strict=True)]
        plain, odd = [i for i, n in enumerate(least) if n], [i for i, n in enumerate(least) if not n]
        out: dict[bytes, bytes] = {}
        step = int(self.width[-1])
        parts = [plain[a : a + ASKED] for a in range(0, len(plain), ASKED)]
        asked = self.tokenizer.encode_batch_fast([" ".join([texts[i] for i in p]) for p in parts], add_special_tokens=False)
        for part, made in zip(parts, asked, strict=True):
            ids = np.array(made.ids, self.width)
            at = np.flatnonzero(self.ends[ids]) + 1
            upto = np.cumsum([least[i] for i in part])
            if len(at) != upto[-1]:
                odd += part
                continue
            raw, cut = ids.tobytes(), [0, *(at[upto - 1] * step).tolist()]
            out.update(zip([words[i] for i in part], [raw[x:y] for x, y in zip(cut, cut[1:], strict=False)], strict=True))
        out.update(zip([words[i] for i in odd], self._each([texts[i] for i in odd]), strict=True))
        return out

    def _piece(self, core: str) -> bytes | None:
        """The ids of plain letters, None for anything else."""
        low = core.lower()
        ids = self.older.get(core)
        if ids is None and _PLAIN.fullmatch(low):
            ids = array(self.kind, [t.id for t in self.model.tokenize(low if low.isascii() else low.encode().decode("latin-1").translate(self.letters))]).tobytes()
        if len(self.pieces) >= PIECES:
            self.older = dict(self.pieces)
            self.pieces.clear()  # the same dictionary, which a loop may hold
        if len(core) <= 64:
            self.pieces[core] = ids
        return ids

    def _tail(self, tail: str) -> bytes:
        ids = self._each([tail])[0]
        if len(tail) <= 8 and len(self.tails) < PIECES:
            self.tails[tail] = ids
        return ids

    def _known(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words."""
        if self.model is None or not words:
            return self._cached(words)
        out: list[bytes | None] = []
        odd: list[int] = []
        piece, tail = self.pieces.get, self.tails.get
        for i, text in enumerate(b" ".join(words).decode().split(" ")):
            core = text.rstrip(_TAIL)
            ids = piece(core) or self._piece(core)
            if ids is None:
                odd.append(i)
            elif len(core) < len(text):
                end = text[len(core) :]
                ids += tail(end) or self._tail(end)
            out.append(ids)
        for i, ids in zip(odd, self._cached([words[i] for i in odd]), strict=True):
            out[i] = ids
        return out

    def _cached(self, words: list[bytes]) -> list[bytes]:
        new, old = self.new, self.old
        out = [new.get(w) for w in words]
        missing = [i for i, x in enumerate(out) if x is None]
        unknown: list[int] = []
        for i in missing:
            x = old.get(words[i])
            if x is None:
                unknown.append(i)
            else:
                out[i] = new[words[i]] = x
                self.size += len(words[i]) + len(x) + ENTRY
        learned = self._learned([words[i] for i in unknown])
        for i in unknown:
            out[i] = learned[words[i]]
        new.update(learned)
        self.size += sum(map(len, learned)) + sum(map(len, learned.values())) + ENTRY * len(learned)
        if self.size > CACHE // 2:
            self.old, self.new, self.size = new, {}, 0
        return out

    def forget(self) -> None:
        """Empty the cache at the end of a task, so that a worker that waits for others holds the tokenizer only."""
        self.old, self.new, self.size = {}, {}, 0
        self.pieces.clear()
        self.older.clear()
        self.tails.clear()
        pa.default_memory_pool().release_unused()

    def encode(self, column: pa.Array) -> pa.Array:
        """The ids of each text of a string column, as bytes; a null text counts as empty."""
        end = np.array([END], self.width)
        if not self.by_word:
            return pa.array([ids + end.tobytes() for ids in self._each([t or "" for t in column.to_pylist()])], pa.binary())
        texts = text_bytes(column)
        if self.lower:  # special tokens are told before lower-casing, so a text that might hold one keeps its case
            texts = [t if self.marks.search(t) else t.lower() for t in texts]
        joined = b"".join(texts).translate(BLANKS)  # so that words differ by what follows them less often
        begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        first, many = _words(np.frombuffer(joined, np.uint8), begin)
        # words reach to the next one here; the blanks go once words are distinct
        spread = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(np.append(first, len(joined)).astype(np.int64)), pa.py_buffer(joined)])
        coded = spread.dictionary_encode()
        ids = self._known([w.rstrip(b" ") for w in coded.dictionary.to_pylist()])
        pool = np.frombuffer(b"".join(ids), self.width)
        size = np.array([len(x) for x in ids], np.int64) // pool.itemsize
        of = coded.indices.to_numpy(zero_copy_only=False)
        length = size[of]
        upto = np.cumsum(length)
        flat = pool[np.arange(int(length.sum()), dtype=np.int32) + np.repeat(((np.cumsum(size) - size)[of] - (upto - length)).astype(np.int32), length)]
        stop = np.concatenate([[0], upto])[np.concatenate([[0], np.cumsum(many)])]  # ids before each text, and in all
        out = np.insert(flat, stop[1:], end[0])
        offsets = (stop + np.arange(len(stop))) * pool.itemsize
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())


#: The encoder of this Python worker; later tasks find its tokenizer loaded, and tasks of later stages drop it.
_loaded: dict[tuple[int, str], _Ids] = {}


def _encoder(spec: str, width: str) -> _Ids:
    key = (hash(spec), width)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = _Ids(spec, width)
    return _loaded[key]


def _forget() -> None:
    """Drop the cache: a later stage has no use for it. A function of the module, since nested ones are sent with copies of what they name."""
    _loaded.clear()


def _key_hash(doc: Column, place: Column) -> tuple[Column, Column]:
    """The key's hash and its fingerprint, which another hash function gives."""
    parts = (F.coalesce(doc, F.lit(0)), doc.isNull(), place)
    return F.xxhash64(*parts).alias("key"), F.hash(*parts).alias("mark")


class _Ranges:
    """Which shard a document goes to, in order of doc_id and, for an id that fills more than a shard, of the payload's first byte."""

    def __init__(self, bounds: list[int], hot: list[int], hot_null: bool) -> None:
        """bounds: the last id of each range but the last; hot: ids with ranges of their own."""
        self.bounds = np.array(sorted({*bounds, *hot, *(h - 1 for h in hot if h > -(1 << 63))}), np.int64)
        own = np.searchsorted(self.bounds, np.array(sorted(hot), np.int64))
        self.hot = np.zeros(len(self.bounds) + 2, bool)
        self.hot[own] = True
        self.hot[-1] = hot_null
        wide = np.where(self.hot, SUBS, 1)
        self.first = np.cumsum(wide) - wide
        self.shards = int(wide.sum())

    def of(self, docs: list[int | None], payload: list[bytes]) -> np.ndarray:
        null = np.array([d is None for d in docs], bool)
        at = np.searchsorted(self.bounds, np.array([d or 0 for d in docs], np.int64))
        at[null] = len(self.hot) - 1
        sub = np.array([p[0] for p in payload], np.int64)  # the end id is always there
        return self.first[at] + np.where(self.hot[at], sub, 0)

    def split(self) -> list[tuple[int, int]]:
        """First and last shard of each id that has several."""
        return [(int(self.first[i]), int(self.first[i]) + SUBS - 1) for i in np.flatnonzero(self.hot)]


def _ranges(docs: DataFrame, ids: DataFrame, docs_per_shard: int | None) -> tuple[_Ranges, int]:
    """Ranges of about docs_per_shard documents, or SHARD_BYTES of text where that is None; and the number of documents."""
    size = F.sum(F.octet_length("text")) if docs_per_shard is None else F.lit(0)
    count, total = docs.agg(F.count("*"), size).first()
    each = docs_per_shard or max(1, -(-count * SHARD_BYTES // max(1, total or 1)))
    n = max(1, -(-count // each))
    if n == 1:
        return _Ranges([], [], False), count
    many = ids.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > each).collect()  # fewer than there are shards
    ranged = ids.where("doc_id IS NOT NULL").repartitionByRange(n, "doc_id").groupBy(F.spark_partition_id()).agg(F.max("doc_id").alias("last")).toArrow()
    last = sorted(ranged.column("last").to_pylist())[:-1]
    return _Ranges(last, [r["doc_id"] for r in many if r["doc_id"] is not None], any(r["doc_id"] is None for r in many)), count


def write(docs: DataFrame, folder: str, *, path: str | None = None, docs_per_shard: int | None = None) -> None:
    """Encode docs (doc_id, text) and write a store. Null texts have just the end id; repeated ids keep one entry each, in order of their ids' bytes.

    Rows without an id are documents of the id null, the last. Texts may have
    any length, but a document is one payload, which a task holds. An empty
    table gives a store without documents. Other columns are ignored, whatever
    their names. Shards are cut by bytes of text, unless docs_per_shard says how
    many documents one has; there is no bound on their number.
    """
    spark = docs.sparkSession
    prepared(spark)
    with open(path or default_path(), encoding="utf-8") as f:
        text = f.read()
    from tokenizers import Tokenizer

    width = "<u2" if Tokenizer.from_str(text).get_vocab_size() <= 1 << 16 else "<u4"
    spec = spark.sparkContext.broadcast(text)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    ranges, count = _ranges(docs, ids, docs_per_shard)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec.value, width)
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                docs_, payload = batch.column("doc_id"), encoder.encode(batch.column("text"))
                heads = pa.compute.binary_slice(payload, 0, 1).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(ranges.of(docs_.to_pylist(), heads).astype(np.int32)), docs_, payload], ["shard", "doc_id", "payload"])
        encoder.forget()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by shard, doc_id: blocks of whole documents."""
        _forget()
        step = int(width[-1])
        held: list[tuple] = []
        size = block = place = 0
        shard = last = None

        def made() -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())
            row = (shard, block, size // step, [h[0] for h in held], [h[1] for h in held], [len(h[2]) // step for h in held], b"".join([h[2] for h in held]))
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["shard", "block", "n_ids", "docs", "places", "lengths", "payload"])

        for batch in batches:
            for s, d, p in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "payload")), strict=True):
                if s != shard or size >= BLOCK_BYTES:
                    if held:
                        yield made()
                    block = block + 1 if s == shard else 0
                    held, size = [], 0
                place = place + 1 if s == shard and d == last and shard is not None else 0
                shard, last = s, d
                held.append((d, place, p))
                size += len(p)
        if held:
            yield made()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "shard int, doc_id long, payload binary")
    dealt = rows.repartition(ranges.shards, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_last(), "payload")
    dealt.mapInArrow(pack, "shard int, block int, n_ids long, docs array<long>, places array<int>, lengths array<int>, payload binary").withColumn("width", F.lit(width)).write.option("parquet.block.size", ROW_GROUP).parquet(f"{folder}/blocks")
    blocks = spark.read.parquet(f"{folder}/blocks")
    each = blocks.select("shard", "block", "n_ids", F.size("docs").alias("n_docs"))
    before = F.coalesce(F.sum("n_ids").over(W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = written(each.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"), F.sum("n_docs").alias("n_docs")), "shards")
    shards = sums_before(totals.select("shard", "n_ids"), "shard", "n_ids").select("shard", "base")
    each.withColumn("within", before).join(shards, "shard").select("shard", "block", (F.col("base") + F.col("within")).alias("start")).write.parquet(f"{folder}/starts")
    # places of one id go on from one of its shards to the next
    earlier: dict[int, int] = {}
    for first, last in ranges.split():
        n = {r["shard"]: r["n_docs"] for r in totals.where(F.col("shard").between(first, last)).collect()}
        for shard in range(first + 1, last + 1):
            earlier[shard] = earlier.get(shard - 1, 0) + n.get(shard - 1, 0)
    buckets = max(1, -(-count // KEYS))

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """An entry for each document; only the blocks' narrow columns are read again."""
        _forget()
        for batch in batches:
            shard, block, docs_, places, lengths = (batch.column(c).to_pylist() for c in ("shard", "block", "docs", "places", "lengths"))
            places = [[p + earlier[s] for p in x] if earlier.get(s) else x for s, x in zip(shard, places, strict=True)]
            n = [len(x) for x in lengths]
            flat = np.concatenate([np.array(x, np.int64) for x in lengths]) if n else np.empty(0, np.int64)
            off = np.concatenate([np.cumsum(x) - x for x in (np.array(x, np.int64) for x in lengths)]) if n else flat
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(shard, n).astype(np.int32)), pa.array(np.repeat(block, n).astype(np.int32)), pa.array([d for x in docs_ for d in x], pa.int64()), pa.array([p for x in places for p in x], pa.int32()), pa.array(off), pa.array(flat)],
                ["shard", "block", "doc", "place", "offset", "length"],
            )

    entries = blocks.select("shard", "block", "docs", "places", "lengths").mapInArrow(offsets, "shard int, block int, doc long, place int, offset long, length long")
    entries = entries.select(*_key_hash(F.col("doc"), F.col("place")), "shard", "block", "offset", "length").withColumn("bucket", F.pmod("key", F.lit(buckets)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    built = entries.repartition(parts, "bucket").sortWithinPartitions("bucket", "key").mapInArrow(_build, "bucket long, n int, levels array<binary>, slots binary, left binary")
    built.withColumn("buckets", F.lit(buckets).cast("long")).write.parquet(f"{folder}/index")


_ENTRY = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("block", "<u4"), ("offset", "<u8"), ("length", "<u8")])


def _level_hash(keys: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys.view(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def perfect_hash(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Levels of bits, and the slot (0 to n - 1) of each of the n distinct keys."""
    slots, levels = np.full(len(keys), -1, np.int64), []
    rest, base = np.arange(len(keys)), 0
    while len(rest):
        size = max(64, SPREAD * len(rest) + 63 & ~63)
        at = (_level_hash(keys[rest], len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        hit = alone[at]
        slots[rest[hit]] = base + np.cumsum(alone)[at[hit]] - 1
        levels.append(alone)
        base, rest = base + int(alone.sum()), rest[~hit]
    return levels, slots


_WORD = np.dtype([("bits", "<u8"), ("rank", "<u4")])


def packed_level(bits: np.ndarray, base: int) -> bytes:
    """A level as 64-bit words (the first bit lowest), each with the number of bits set before it in this and earlier levels."""
    out = np.zeros(len(bits) // 64, _WORD)
    out["bits"] = np.packbits(bits, bitorder="little").view("<u8")
    each = np.bitwise_count(out["bits"]).astype(np.int64)
    out["rank"] = base + np.cumsum(each) - each
    return out.tobytes()


def packed_levels(levels: list[np.ndarray]) -> list[bytes]:
    bases = np.concatenate([[0], np.cumsum([int(x.sum()) for x in levels])]).astype(np.int64)
    return [packed_level(x, int(b)) for x, b in zip(levels, bases, strict=False)]


def slots_of(levels: list[bytes], keys: np.ndarray) -> np.ndarray:
    """The slot of each key, in a time that doesn't depend on how many there are; -1 where no level has its bit. A key that wasn't there at building may get any slot."""
    slots, rest = np.full(len(keys), -1, np.int64), np.arange(len(keys))
    for i, raw in enumerate(levels):
        words = np.frombuffer(raw, _WORD)
        at = _level_hash(keys[rest], i) % np.uint64(64 * len(words))
        word, place = words[(at >> np.uint64(6)).astype(np.int64)], at & np.uint64(63)
        hit = ((word["bits"] >> place) & np.uint64(1)).astype(bool)
        below = np.bitwise_count(word["bits"] & ((np.uint64(1) << place) - np.uint64(1)))
        slots[rest[hit]] = (word["rank"] + below.astype(np.int64))[hit]
        rest = rest[~hit]
    return slots


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries sorted by bucket: the hash and slots of each bucket. Keys whose 64-bit hashes collide go to a list beside it."""
    _forget()
    held, rows = None, []

    def made() -> pa.RecordBatch:
        keys, marks, *entry = (np.concatenate(x) for x in zip(*rows, strict=True))
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        levels, slots = perfect_hash(keys[first])
        table = np.zeros(len(keys), _ENTRY)
        table["fingerprint"] = marks.view(np.uint32)
        for name, x in zip(("shard", "block", "offset", "length"), entry, strict=True):
            table[name] = x
        own = np.empty(int(first.sum()), _ENTRY)
        own[slots] = table[first]
        return pa.RecordBatch.from_arrays([pa.array([held], pa.int64()), pa.array([len(own)], pa.int32()), pa.array([packed_levels(levels)], pa.list_(pa.binary())), pa.array([own.tobytes()], pa.binary()), pa.array([table[~first].tobytes()], pa.binary())], ["bucket", "n", "levels", "slots", "left"])

    for batch in batches:
        bucket = batch.column("bucket").to_numpy(zero_copy_only=False)
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "mark", "shard", "block", "offset", "length")]
        cut = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
        for a, b in zip(cut, cut[1:], strict=False):
            if a == b:
                continue
            if bucket[a] != held:
                if rows:
                    yield made()
                held, rows = int(bucket[a]), []
            rows.append([c[a:b] for c in columns])
    if rows:
        yield made()


def keys_of(docs: DataFrame) -> DataFrame:
    """doc_id, place of each row of docs: the keys of a store of docs. Places of one id, or of null, count from 0. An empty table has no keys; other columns are ignored."""
    n = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n"))
    return n.select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("place"))


def look_up(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """doc_id, place, shard, block, offset, length of the keys (doc_id, place) that the index has. An absent key is told by its fingerprint, one in 2**32 mistaken."""
    prepared(spark)
    index = spark.read.parquet(f"{folder}/index")
    some = index.select("buckets").first()
    buckets = some["buckets"] if some else 1
    asked = keys.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("place").cast("int").alias("place"))
    asked = asked.select("doc_id", "place", *_key_hash(F.col("doc_id"), F.col("place"))).withColumn("bucket", F.pmod("key", F.lit(buckets)))
    # salted, so that a bucket that is asked very often isn't gathered in one row
    asked = asked.groupBy("bucket", F.shiftright("key", 61).alias("salt")).agg(F.collect_list(F.struct("doc_id", "place", "key", "mark")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for n, levels, raw, left, asked_ in zip(*(batch.column(c).to_pylist() for c in ("n", "levels", "slots", "left", "asked")), strict=True):
                keys = np.array([a["key"] for a in asked_], np.int64)
                marks = np.array([a["mark"] for a in asked_], np.int32).view(np.uint32)
                # entries of keys whose 64-bit hash another key has stand after the slots, told by fingerprint alone
                table = np.concatenate([np.frombuffer(raw, _ENTRY), np.frombuffer(left, _ENTRY)])
                slot = slots_of(levels, keys)
                missed = (slot < 0) | (table["fingerprint"][slot] != marks)
                if len(table) > n:
                    others = {int(f): n + i for i, f in enumerate(table["fingerprint"][n:])}
                    slot[missed] = [others.get(int(m), -1) for m in marks[missed]]
                    missed = slot < 0
                found = table[slot[~missed]]
                own = [asked_[i] for i in np.flatnonzero(~missed).tolist()]
                out[0] += [a["doc_id"] for a in own]
                out[1] += [a["place"] for a in own]
                for o, name in zip(out[2:], ("shard", "block", "offset", "length"), strict=True):
                    o += found[name].tolist()
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], ["doc_id", "place", "shard", "block", "offset", "length"])

    return index.join(asked, "bucket").select("n", "levels", "slots", "left", "asked").mapInArrow(run, "doc_id long, place int, shard int, block int, offset long, length long")


def _sections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each document of the blocks begins and ends, and its ids."""
    _forget()
    for batch in batches:
        for shard, block, lengths, payload, width in zip(*(batch.column(c).to_pylist() for c in ("shard", "block", "lengths", "payload", "width")), strict=True):
            n, step = np.array(lengths, np.int64), int(width[-1])
            upto = np.cumsum(n)
            ids = [payload[a:b] for a, b in zip(((upto - n) * step).tolist(), (upto * step).tolist(), strict=True)]
            columns = [pa.array([shard] * len(n), pa.int32()), pa.array([block] * len(n), pa.int32()), pa.array(upto - n), pa.array(n), pa.array(ids, pa.binary()), pa.array([width] * len(n), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "block", "offset", "length", "ids", "width"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sections with a digest in place of the ids."""
    for batch in _sections(batches):
        crc = [zlib.crc32(np.frombuffer(raw, width).astype("<u4").tobytes()) for raw, width in zip(batch.column("ids").to_pylist(), batch.column("width").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(crc, pa.int64())], ["shard", "block", "offset", "length", "ids_crc32"])


_SECTION = "shard int, block int, offset long, length long"


def _found(spark: SparkSession, folder: str, keys: DataFrame, run, more: str) -> DataFrame:
    """What the index says of the keys, with start and what `run` makes of each section (columns `more`).

    Blocks are read where they lie, and only sections meet the requests. Few
    blocks are told by their numbers, which are broadcast behind a count.
    """
    at = written(look_up(spark, folder, keys), "found")
    touched = at.select("shard", "block").distinct()
    blocks = spark.read.parquet(f"{folder}/blocks").select("shard", "block", "lengths", "payload", "width")
    if touched.count() <= FEW:
        blocks = blocks.join(F.broadcast(touched), ["shard", "block"], "left_semi")
    sections = blocks.mapInArrow(run, f"{_SECTION}, {more}")
    starts = spark.read.parquet(f"{folder}/starts")
    return at.join(sections, ["shard", "block", "offset", "length"]).join(starts, ["shard", "block"]).withColumn("start", F.col("start") + F.col("offset"))


def read(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """doc_id, place, start (ids of all documents before it), ids (raw bytes), width of the keys' documents, from the files."""
    return _found(spark, folder, keys, _sections, "ids binary, width string").select("doc_id", "place", "start", "ids", "width")


def digests(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers) of what read() gives; ids are digested where they lie."""
    return _found(spark, folder, keys, _digested, "ids_crc32 long").select("doc_id", "start", F.col("length").alias("n_tokens"), "ids_crc32")
