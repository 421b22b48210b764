"""Which patterns a text can match at all, told in one pass by the literals that they need.

A trie with failure links (Aho-Corasick) over the needs of all entries goes over
each text once, in time that doesn't grow with the number of literals. An entry
none of whose literals occur is not searched for. The trie is made of the
lexicon alone, so what travels with the tasks doesn't grow with the documents.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .lexicon import Entry

#: ASCII capitals, and the characters that patterns in any case take for ASCII letters.
FOLDED = {i: i + 32 for i in range(65, 91)} | {0x130: "i", 0x131: "i", 0x17F: "s", 0x212A: "k"}
_LOWER = bytes(range(256)).lower()
_OTHERS = [(chr(i), c) for i, c in FOLDED.items() if i > 127]
_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")


def folded(text: str) -> str:
    """text.translate(FOLDED), which goes through a text that isn't all ASCII character by character: capitals are replaced as bytes, of which no other character has any."""
    out = text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")
    if not text.isascii():
        for other, letter in _OTHERS:
            out = out.replace(other, letter)
    return out


class LiteralIndex:
    """The literals of the entries, and for each what it takes to count and the numbers of the entries that need it."""

    def __init__(self, entries: Sequence[Entry]) -> None:
        import ahocorasick

        self.always = [i for i, e in enumerate(entries) if not e.needs]
        uses: dict[str, dict[tuple[str | None, bool], set[int]]] = defaultdict(lambda: defaultdict(set))
        for i, e in enumerate(entries):
            for n in e.needs:
                uses[n.literal][n.exact, n.inside].add(i)
        self._trie = ahocorasick.Automaton()
        for literal, ways in uses.items():
            self._trie.add_word(literal, (len(literal), [(exact, inside, tuple(own)) for (exact, inside), own in ways.items()]))
        if uses:
            self._trie.make_automaton()
        self._empty = not uses

    def needed(self, text: str) -> list[int]:
        """Numbers of the entries that the text may match."""
        found = set(self.always)
        if self._empty or not text:
            return sorted(found)
        for end, (length, ways) in self._trie.iter(folded(text)):
            start = end - length + 1
            for exact, inside, own in ways:
                if (inside or not start or text[start - 1] not in _WORD) and (exact is None or text.startswith(exact, start)):
                    found.update(own)
        return sorted(found)


def with_needed(docs: DataFrame, entries: Sequence[Entry], column: str = "text") -> DataFrame:
    """docs with `needed__`, the numbers of the entries that each text may match."""
    ship(docs.sparkSession)
    given = tuple(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LiteralIndex(given)
        for batch in batches:
            needed = [index.needed(t or "") for t in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(needed, pa.list_(pa.int32()))], [*batch.schema.names, "needed__"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("needed__", T.ArrayType(T.IntegerType()))]))


def evaluations(docs: DataFrame, entries: Sequence[Entry]) -> DataFrame:
    """One row: documents, tested (patterns tried in all), of (patterns there are for all documents)."""
    n = with_needed(docs.select("text"), entries).select(F.size("needed__").alias("n"))
    return n.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("tested"), (F.count("*") * len(entries)).alias("of"))
