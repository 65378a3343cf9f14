"""Token ids of texts under a public byte-level BPE vocabulary.

A piece of text (as the vocabulary's pattern cuts it) starts as one symbol a byte in a doubly linked list. A priority queue
holds the rank of every neighbouring pair that the vocabulary knows; the lowest rank, leftmost first, is merged, and the
merged symbol's two new pairs are queued. Entries whose symbols have changed since are skipped when they come up.
Decoding joins the vocabulary's byte strings. Nothing is trained here.

Defined results. A null and an empty text have no ids: the empty list, never null. The strings of special tokens are ordinary text.
Every row gives one row. Columns other than the key and the text are not looked at.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces a task remembers. Beyond that it forgets all and goes on.
REMEMBERED = 400_000


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """The vocabulary from a file of lines "base64 rank"."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    after = list(range(1, n + 1))  # where the symbol that starts here ends, which is where the next one starts
    before = list(range(-1, n - 1))  # where the symbol before starts
    alive = [True] * n
    queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(queue)
    while queue:
        _, left, end = heappop(queue)
        right = after[left]
        if not alive[left] or right >= n or after[right] != end:
            continue
        alive[right] = False
        after[left] = end
        if end < n:
            before[end] = left
            if (r := ranks.get(piece[left : after[end]])) is not None:
                heappush(queue, (r, left, after[end]))
        if (previous := before[left]) >= 0 and (r := ranks.get(piece[previous:end])) is not None:
            heappush(queue, (r, previous, end))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : after[at]]])
        at = after[at]
    return ids


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.find, self.seen = ranks, regex.compile(pattern).findall, {}

    def ids(self, text: str | None) -> list[int]:
        out: list[int] = []
        seen = self.seen
        for piece in self.find(text or ""):
            if (known := seen.get(piece)) is None:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                known = merge(piece.encode(), self.ranks)
                if len(piece) < 100:
                    seen[piece] = known
            out += known
        return out


def decode(ids: list[int], ranks: dict[bytes, int]) -> str:
    strings = {v: k for k, v in ranks.items()}
    return b"".join(strings[i] for i in ids).decode("utf-8", "replace")


def _encoding(shared, pattern: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(read_ranks(shared.value), pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                found = [encoder.ids(t) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                flat = np.fromiter((i for ids in found for i in ids), np.int32, int(ends[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["key", "ids"])

    return encode


def token_ids(texts: DataFrame, key: str, text: str, folder: str, vocabulary: str = "byte_bpe_50k.tiktoken", pattern: str | None = None) -> DataFrame:
    """(key, ids): one row for each row. The vocabulary, of fixed size, is read once by the driver and sent to the tasks; no shuffle."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    with open(f"{folder}/{vocabulary}", "rb") as file:
        shared = texts.sparkSession.sparkContext.broadcast(file.read())
    kind = texts.schema[key].dataType.simpleString()
    pairs = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return pairs.mapInArrow(_encoding(shared, pattern), f"key {kind}, ids array<int>").withColumnRenamed("key", key)
