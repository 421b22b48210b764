"""BPE encoding with a priority queue of merge ranks over a linked list, and decoding.

A document is cut at ASCII blanks; no token spans one, because the tokenizer's
pattern drops white space. Each distinct word of a task is encoded once and
kept in a bounded cache, so the merge loop runs on new words only.
"""

from __future__ import annotations

import heapq
import json
import re
import string
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepared, slices, text_bytes


def default_path() -> str:
    """The installed word-level vocabulary; any file of the same kind may be named instead."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable, else the next code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], free = chr(free), free + 1
    return out


#: Punctuation that is split from letters before it; an apostrophe may belong to a contraction.
_TAIL = string.punctuation.replace("'", "")


class WordBpe:
    """Encoder and decoder for a tokenizer file with NFC, lower case, a split pattern, byte letters and a word-end suffix."""

    def __init__(self, spec: str, words: int = 100_000, pieces: int = 250_000) -> None:
        j = json.loads(spec)
        model, self.most = j["model"], (words, pieces)
        if model.get("type", "BPE") != "BPE" or not model.get("end_of_word_suffix"):
            raise ValueError("this needs a tokenizer file of the word-end BPE kind")
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: (left id, right id) in one number -> rank; the result of each rank
        self.rank = {self.vocab[a] << 20 | self.vocab[b]: r for r, (a, b) in enumerate(pairs)}
        self.made = [self.vocab[a + b] for a, b in pairs]
        self.suffix: str = model["end_of_word_suffix"]
        letters = _byte_letters()
        self.inner = [self.vocab[letters[b]] for b in range(256)]
        self.final = [self.vocab[letters[b] + self.suffix] for b in range(256)]
        pattern = next(p["pattern"]["Regex"] for p in j["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.added = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.special = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.marks = {t[:2].encode() for t in self.added}
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.strings = [""] * (max([*self.vocab.values(), *self.added.values()]) + 1)
        for text, i in [*self.vocab.items(), *self.added.items()]:
            self.strings[i] = text

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply merges in order of rank, leftmost first. An entry of the queue is stale if its place no longer holds a pair of its rank."""
        n, rank = len(symbols), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [r << 40 | i for i in range(n - 1) if (r := rank.get(symbols[i] << 20 | symbols[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            r, i = entry >> 40, entry & 0xFFFFFFFFFF
            j = after[i]
            if symbols[i] < 0 or j >= n or rank.get(symbols[i] << 20 | symbols[j]) != r:
                continue
            symbols[i], symbols[j] = self.made[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := rank.get(symbols[i] << 20 | symbols[k])) is not None:
                    heapq.heappush(queue, s << 40 | i)
            if (h := before[i]) >= 0 and (s := rank.get(symbols[h] << 20 | symbols[i])) is not None:
                heapq.heappush(queue, s << 40 | h)
        return [s for s in symbols if s >= 0]

    def piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            raw = piece.encode()
            ids = array("i", self.merge([*(self.inner[b] for b in raw[:-1]), self.final[raw[-1]]])).tobytes()
            if len(self.pieces) >= self.most[1]:
                self.pieces.clear()
            if len(piece) <= 64:
                self.pieces[piece] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        if text.isascii():
            text = text.lower()
        else:
            # lower case is by code point here: no rule for a final sigma
            text = unicodedata.normalize("NFC", text)
            text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        # the common case: letters, and perhaps punctuation after them
        core = text.rstrip(_TAIL)
        if core.isalpha():
            return self.piece(core) + (self.piece(text[len(core) :]) if len(core) < len(text) else b"")
        return b"".join(map(self.piece, self.split.findall(text)))

    def word(self, raw: bytes) -> bytes:
        """The ids of one word without ASCII blanks, as 32-bit integers in native order."""
        text = raw.decode()
        if self.special and any(m in raw for m in self.marks):
            ids = b"".join(array("i", [self.added[part]]).tobytes() if part in self.added else self._plain(part) for part in self.special.split(text) if part)
        else:
            ids = self._plain(text)
        if len(self.words) >= self.most[0]:
            self.words.clear()
        if len(raw) <= 64:
            self.words[raw] = ids
        return ids

    def encode(self, raw: bytes) -> bytes:
        words, get = self.words, self.word
        if not any(m in raw for m in self.marks):
            raw = raw.lower()  # fewer distinct words; special tokens are told by their case
        return b"".join([words.get(w) or get(w) for w in raw.split()])

    def forget(self) -> None:
        """Empty the caches at the end of a task, so that a worker that waits for others holds the vocabulary only."""
        self.words.clear()
        self.pieces.clear()
        pa.default_memory_pool().release_unused()

    def decode(self, ids) -> str:
        """Vocabulary strings joined by one space, which is what a tokenizer file without a decoder asks for."""
        return " ".join(map(self.strings.__getitem__, ids))


#: The encoder of this Python worker, by the file's content; later tasks find its vocabulary loaded.
_loaded: dict[int, WordBpe] = {}


def _encoder(spec: str) -> WordBpe:
    key = hash(spec)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = WordBpe(spec)
    return _loaded[key]


def encoded(docs: DataFrame, *, path: str | None = None, decode: bool = False) -> DataFrame:
    """docs with `text` replaced by ids (array of int), and `decoded` if asked for.

    A null or blank text has no ids and decodes to the empty string. Columns
    that docs has under the names of the result's are replaced; all others pass
    through, whatever their names. Repeated rows stay, and an empty table stays
    empty. Texts may have any length: words are encoded one by one.
    The file is read on the driver and broadcast; its size is the vocabulary's.
    """
    prepared(docs.sparkSession)
    with open(path or default_path(), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    rest = [c for c in docs.columns if c not in ("text", "ids", *["decoded"] * decode)]
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField("ids", T.ArrayType(T.IntegerType(), False))] + [T.StructField("decoded", T.StringType())] * decode)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(spec.value)
        for whole in batches:
            for batch in slices(whole, "text"):
                packed = [bpe.encode(t) for t in text_bytes(batch.column("text"))]
                ids = np.frombuffer(b"".join(packed), np.int32)
                ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
                out = [batch.column(c) for c in rest] + [pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))]
                if decode:
                    out.append(pa.array([bpe.decode(ids[a:b].tolist()) for a, b in zip(ends, ends[1:], strict=False)], pa.string()))
                yield pa.RecordBatch.from_arrays(out, [*rest, "ids", *["decoded"] * decode])
        bpe.forget()

    return docs.select(*rest, "text").mapInArrow(run, schema)


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of rows with ids and decoded."""
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
