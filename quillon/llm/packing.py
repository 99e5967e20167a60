"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Each task packs the documents of its own partition, in groups of some
hundred documents, so no row is shuffled and no group grows with the input.
A document longer than the window is cut: every full window of it is a
sequence by itself, and the rest joins the group's tails. Tails go to k
windows by differencing: partial partitions are merged so that large sums meet
small ones, the two with the largest spread first. If a window exceeds the
capacity, the number of windows rises by one and the differencing starts anew.

Null texts count as empty and give one end token. Repeated rows are packed
each for itself. An empty table gives no pieces. Extra columns are not read.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_scan, byte_symbols, release, utf8

WINDOW = 2048
END_ID = 1
GROUP = 384
#: Bytes that each of a task's two memos holds at most, and what an entry takes beside its key and value.
MEMO_BYTES, ENTRY = 96 << 20, 160
#: Texts and bytes that are encoded at once; a longer text goes by itself.
TEXTS, BYTES = 384, 1 << 19
#: Parts of chunks in a string for the model, and strings that it is given at once.
LINE, LINES = 500, 32
#: One line each: lower-case Latin letters that have one form under NFC, then ASCII marks without the apostrophe; or anything else.
PLAIN = re.compile(r"^(?:([a-z\u00e0-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)|.*)$", re.MULTILINE).findall


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: indices of `sizes` dealt to k windows of near-equal sums."""
    # a partial partition: its windows in use as (sum, tree of members) by descending sum; a leaf is (member, None)
    heap = [(-n if k > 1 else 0, i, [(n, (i, None))]) for i, n in enumerate(sizes)]
    heapq.heapify(heap)
    mark = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        both = len(a) + len(b) - k
        if both <= 0:  # all meet empty windows
            merged = a + b
        else:  # largest with smallest
            merged = a[:-both] + b[:-both] + [(s + t, (x, y)) for (s, x), (t, y) in zip(a[-both:], reversed(b[-both:]))]
        merged.sort(key=itemgetter(0), reverse=True)
        least = merged[-1][0] if len(merged) == k else 0
        heapq.heappush(heap, (least - merged[0][0], mark, merged))
        mark += 1
    out = [list(_members(tree)) for _, tree in heap[0][2]] if heap else []
    return out + [[] for _ in range(k - len(out))]


def _members(tree) -> Iterator[int]:
    stack = [tree]
    while stack:
        left, right = stack.pop()
        if right is None:
            yield left
        else:
            stack += [right, left]


def windows_for(sizes: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """Windows within the capacity; as few as differencing can fill."""
    if not sizes:
        return []
    if max(sizes) > capacity:
        raise ValueError("a piece exceeds the window")
    k = -(-sum(sizes) // capacity)
    while True:
        out = difference(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in out):
            return [w for w in out if w]
        k += 1


class Memo(dict):
    """Ids of chunks or parts, emptied when they come to more than so many bytes."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.size = limit, 0

    def learn(self, keys: list, values: list[bytes]) -> None:
        self.update(zip(keys, values))
        self.size += ENTRY * len(keys) + sum(map(len, keys)) + sum(map(len, values))

    def trim(self) -> None:
        if self.size > self.limit:
            self.clear()
            self.size = 0


class WordIds:
    """Token ids of texts, as the library gives them for each chunk between white space by itself.

    New words come without end, and for short texts most of the library's time
    goes into normalising and splitting. Chunks of Latin letters and trailing
    marks are therefore split here, and their parts go, many at once, to the
    same model without those steps: the last token of a part, and no other,
    carries the end-of-word suffix. Every other chunk takes the whole way.
    Ids are kept as bytes, so that a text's ids are one join.
    """

    def __init__(self, path: str, memo_bytes: int = MEMO_BYTES):
        # a task has one core: threads of the library's own would only take memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.whole = (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)
        self.bare = (normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit())
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        symbols = byte_symbols()
        self.symbols = {chr(c): "".join(symbols[b] for b in chr(c).encode()) for c in range(128, 256)}
        self.chunks, self.parts = Memo(memo_bytes), Memo(memo_bytes)
        del vocab
        release()  # what reading the file took

    def _ids(self, texts: list[str], steps: tuple) -> list[np.ndarray]:
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = steps
        out = []
        for i in range(0, len(texts), LINES):  # what the library makes of a token takes far more than its id
            out += [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts[i : i + LINES], add_special_tokens=False)]
        return out

    def _learn_parts(self, parts: list[str]) -> None:
        shown = "\n".join(parts)
        # no stand-in holds another of these letters
        for c in {c for c in set(shown) if c > "\x7f"}:
            shown = shown.replace(c, self.symbols[c])
        shown = shown.split("\n")
        ids = np.concatenate(self._ids([" ".join(shown[i : i + LINE]) for i in range(0, len(shown), LINE)], self.bare))
        stops = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
        if len(stops) != len(parts):
            raise ValueError("a part has not exactly one end")
        held = ids.tobytes()
        self.parts.learn(parts, [held[i:j] for i, j in zip([0, *stops], stops)])

    def _learn(self, chunks: list[bytes]) -> None:
        found = PLAIN(b"\n".join(chunks).decode().lower())
        if len(found) != len(chunks):
            raise ValueError("a chunk has a line break")
        parts = self.parts
        new = {x for pair in found for x in pair if x and x not in parts}
        if new:
            self._learn_parts(list(new))
        out = [parts[a] + parts[b] if b else parts[a] if a else b"" for a, b in found]
        odd = [k for k, (a, _) in enumerate(found) if not a]
        if odd:
            for k, ids in zip(odd, self._ids([chunks[k].decode() for k in odd], self.whole)):
                out[k] = ids.tobytes()
        self.chunks.learn(chunks, out)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        self.chunks.trim()
        self.parts.trim()
        split = [t.split() for t in texts]
        chunks = self.chunks
        new = [w for w in set().union(*split) if w not in chunks]  # a set's difference would walk the whole memo
        if new:
            self._learn(new)
        return [b"".join(map(chunks.__getitem__, words)) for words in split]


def _blocks(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows (row, text) in lists of at most TEXTS rows, and BYTES unless one text has more."""
    block, size = [], 0
    for row, text in rows:
        if block and (len(block) == TEXTS or size + len(text) > BYTES):
            yield block
            block, size = [], 0
        block.append((row, text))
        size += len(text)
    if block:
        yield block


def _pack(docs: list[tuple], first: int, capacity: int) -> tuple[list[tuple], int]:
    """Pieces (row, start, length, sequence, offset) of documents (row, ids), and the next free sequence."""
    pieces, tails, seq = [], [], first
    for row, ids in docs:
        full = len(ids) // capacity
        for j in range(full):
            pieces.append((row, ids, j * capacity, capacity, seq, 0))
            seq += 1
        if len(ids) > full * capacity:
            tails.append((row, ids, full * capacity, len(ids) - full * capacity))
    for window in windows_for([t[3] for t in tails], capacity):
        at = 0
        for i in window:
            row, ids, start, n = tails[i]
            pieces.append((row, ids, start, n, seq, at))
            at += n
        seq += 1
    return pieces, seq


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = WINDOW, group: int = GROUP, with_ids: bool = False) -> DataFrame:
    """One row per piece; `tokenizer` is the path of a public tokenizer's file, found by the same path on executors.

    Documents are ids of the text and the end id; pieces of a document cover it without gaps.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    if with_ids:
        schema += ", ids array<int>"

    def out(pieces: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        parts = [ids[s : s + n] for _, ids, s, n, _, _ in pieces]
        columns = [
            pa.array([p[0] for p in pieces], id_type),
            pa.array([p[2] for p in pieces], pa.int64()),
            pa.array([p[3] for p in pieces], pa.int64()),
            pa.array([zlib.crc32(x.tobytes()) for x in parts], pa.int64()),
            pa.array([len(p[1]) for p in pieces], pa.int64()),
            pa.array([p[4] for p in pieces], pa.int64()),
            pa.array([p[5] for p in pieces], pa.int64()),
        ] + ([pa.array([x.astype(np.int32) for x in parts], pa.list_(pa.int32()))] if with_ids else [])
        return pa.RecordBatch.from_arrays(columns, [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = WordIds(tokenizer), np.array([END_ID], "<u4").tobytes()
        seq = TaskContext.get().partitionId() << 40
        waiting: list[tuple] = []
        id_type = None
        for b in batches:
            id_type = b.schema.field(0).type
            rows = zip(b.column(0).to_pylist(), utf8(b.column(1)))
            for some in _blocks(rows):
                ids = words.encode([text for _, text in some])
                waiting += [(row, np.frombuffer(x + end, "<u4")) for (row, _), x in zip(some, ids)]
                while len(waiting) >= 2 * group:  # a group's worth stays, so the last one is never small
                    pieces, seq = _pack(waiting[:group], seq, capacity)
                    del waiting[:group]
                    yield out(pieces, id_type)
        if waiting:
            pieces, seq = _pack(waiting, seq, capacity)
            yield out(pieces, id_type)

    return arrow_scan(docs.select(F.col(id_col), F.col(text_col).cast("string")), scan, schema)
