"""Token counts by byte-pair merging with a heap and a linked list.

The count of a pre-token is its number of byte symbols minus the merges done:
the adjacent pair of the lowest rank (the leftmost of equals) is popped again
and again. No identifier is looked up or emitted. Pre-tokens repeat, so each
task keeps their counts in a bounded memo.

Null texts count as empty: no bytes, no tokens. A special string inside a text
is one token, as the library takes it. Repeated rows are counted each for
itself; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_scan, byte_symbols, utf8

MEMO = 400_000


class PairCounter(dict):
    """Pre-token (text) -> number of tokens."""

    def __init__(self, path: str, pattern: str):
        import regex

        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.symbols = byte_symbols()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.find = regex.compile(pattern).findall
        special = [t["content"] for t in spec["added_tokens"]]
        self.split = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))).split if special else None
        self.special = special

    def __missing__(self, pretoken: str) -> int:
        n = self.merged(pretoken.encode())
        if len(pretoken) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[pretoken] = n
        return n

    def merged(self, data: bytes) -> int:
        symbol = [self.symbols[b] for b in data]
        n, rank = len(symbol), self.rank
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (r := rank.get((symbol[i], symbol[i + 1]))) is not None]
        heapq.heapify(heap)
        count = n
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:  # one of the two was merged before
                continue
            symbol[i], symbol[j] = left + right, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            count -= 1
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := rank.get((symbol[a], symbol[b]))) is not None:
                    heapq.heappush(heap, (r, a, symbol[a], symbol[b]))
        return count

    def count(self, text: str) -> int:
        if self.split and any(s in text for s in self.special):
            parts = self.split(text)
            return len(parts) - 1 + sum(sum(map(self.__getitem__, self.find(p))) for p in parts)
        return sum(map(self.__getitem__, self.find(text)))


@lru_cache(maxsize=4)
def counter(path: str, pattern: str) -> PairCounter:
    return PairCounter(path, pattern)


def token_counts(docs: DataFrame, tokenizer: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer, pattern)
        for b in batches:
            sizes, counts = [], []
            for text in utf8(b.column(1)):
                sizes.append(len(text))
                counts.append(c.count(text.decode()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], [id_col, "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return arrow_scan(rows, scan, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint")
