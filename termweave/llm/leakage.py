"""Evaluation texts inside a corpus.

Every run of ``window`` words of an item and of a document gets a 64-bit SimHash of its word shingles. Two fingerprints within
``radius`` bits agree in at least one of ``radius + 1`` blocks of bits, so a table of item windows by block value finds every
fingerprint within the radius. Candidates are verified by the weighted Jaccard similarity of their shingles (a shingle
weighs more the fewer items have it), then, where a run of equal words is asked for, word by word.

The items are the query set: they are read in blocks of about ``words_at_once`` words, and each block of items meets
all documents in one narrow pass. Documents are neither shuffled nor joined with each other, and no item or document is left out.

`leaked_items` asks for a run of words that both texts share, so its windows have the length of the run: an item also leaks in part.
`near_items` asks for whole items, edited here and there: its windows have the size of the item (of its class of sizes for the search, its own for
the verification), and similarity decides, not equal words.

Defined results. Words are the longest runs of letters and digits, compared without case. Null and empty texts and texts of fewer
words than the window hold no window and match nothing. Repeated rows give one row for each (document, item).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold

WORD = r"[\p{L}\p{N}]+"
_CHUNK = 150_000
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def word_hashes(text: Column) -> Column:
    """A 64-bit hash for each word, in order."""
    words = F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(_MIX[1])
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(_MIX[2])
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the words i .. i+size-1 for every i where they fit."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = _mixed(out * np.uint64(_MIX[0]) + words[k : k + n])
    return out


def simhashes(features: np.ndarray, size: int) -> np.ndarray:
    """Fingerprint of every ``size`` consecutive features: a bit is set if more features have it than not.

    The sums run in 8 bits; they wrap, and so does their difference, which is right while it lies within 8 bits.
    """
    assert 0 < size < 128
    bits = np.unpackbits(features.view(np.uint8).reshape(-1, 8), axis=1).view(np.int8)
    sums = np.zeros((len(features) + 1, 64), np.int8)
    np.cumsum(bits * np.int8(2) - np.int8(1), axis=0, dtype=np.int8, out=sums[1:])
    votes = sums[size:] - sums[:-size]
    return np.packbits(votes > 0, axis=1).view(np.uint64).ravel()


def block_values(prints: np.ndarray, blocks: int) -> list[np.ndarray]:
    """The fingerprint cut into ``blocks`` runs of bits."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    return [(prints >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1) for a, b in zip(edges, edges[1:])]


class ItemWindows:
    """The windows of one block of items, indexed by each block of their fingerprints."""

    def __init__(self, ids: list, words: list[np.ndarray], window: int, shingle: int, radius: int):
        self.window, self.shingle, self.radius, self.ids = window, shingle, radius, ids
        per = window - shingle + 1
        found, owner, rows = [], [], []
        for k, w in enumerate(words):
            s = shingles(w, shingle)
            if len(w) >= window:
                found.append(simhashes(s, per))
                owner.append(np.full(len(w) - window + 1, k))
                rows.append((w, s))
        self.prints = np.concatenate(found) if found else np.empty(0, np.uint64)
        self.owner = np.concatenate(owner) if owner else np.empty(0, np.int64)
        strips = np.lib.stride_tricks.sliding_window_view
        self.words = np.concatenate([strips(w, window) for w, _ in rows]) if rows else np.empty((0, window), np.uint64)
        self.sets = np.concatenate([strips(s, per) for _, s in rows]) if rows else np.empty((0, per), np.uint64)
        # Weight of a shingle: by the number of items that have it.
        parts = [np.unique(s) for _, s in rows]
        self.known, held = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.uint64), np.empty(0))
        self.weights, self.heaviest = np.log1p(len(rows) / np.maximum(held, 1)), float(np.log1p(max(1, len(rows))))
        self.orders, self.sorted = [], []
        for values in block_values(self.prints, radius + 1):
            order = np.argsort(values, kind="stable")
            self.orders.append(order)
            self.sorted.append(values[order])

    def weight(self, s: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(s.shape, self.heaviest)
        at = np.minimum(np.searchsorted(self.known, s), len(self.known) - 1)
        return np.where(self.known[at] == s, self.weights[at], self.heaviest)

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (index into prints, item window) within the radius, each once."""
        pairs = []
        for order, there, values in zip(self.orders, self.sorted, block_values(prints, self.radius + 1)):
            low, high = np.searchsorted(there, values, "left"), np.searchsorted(there, values, "right")
            many = high - low
            mine = np.repeat(np.arange(len(prints)), many)
            start = np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many)
            other = order[start + np.arange(len(mine))]
            near = np.bitwise_count(prints[mine] ^ self.prints[other]) <= self.radius
            pairs.append(mine[near] * len(self.prints) + other[near])
        both = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        return both // max(1, len(self.prints)), both % max(1, len(self.prints))

    def similarity(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Weighted Jaccard of the shingle sets in the rows of two matrices."""

        def first(s: np.ndarray) -> np.ndarray:
            """Marks one of each distinct shingle of a row."""
            same = s[:, :, None] == s[:, None, :]
            return same.argmax(2) == np.arange(s.shape[1])

        shared = (left[:, :, None] == right[:, None, :]).any(2)
        a, b = first(left) * self.weight(left), first(right) * self.weight(right)
        common = (a * shared).sum(1)
        return common / np.maximum(a.sum(1) + b.sum(1) - common, 1e-12)


def _matching(shared, similar: float, exact: bool):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: ItemWindows = shared.value
        window, shingle, per = items.window, items.shingle, items.window - items.shingle + 1
        strips = np.lib.stride_tricks.sliding_window_view
        for batch in batches:
            lists = batch.column(1)
            ends = np.asarray(lists.offsets)
            flat = np.asarray(lists.flatten()).view(np.uint64)
            ends = ends - ends[0]
            starts_of = ends[:-1]
            doc, item = [], []
            # Chunks overlap by a window, so that none is cut.
            for at in range(0, max(0, len(flat) - window + 1), _CHUNK):
                part = flat[at : at + _CHUNK + window - 1]
                s = shingles(part, shingle)
                prints = simhashes(s, per)
                mine, other = items.candidates(prints)
                if not len(mine):
                    continue
                row = np.searchsorted(ends, mine + at, "right") - 1
                inside = mine + at + window <= ends[row + 1]
                mine, other, row = mine[inside], other[inside], row[inside]
                if not len(mine):
                    continue
                alike = items.similarity(strips(s, per)[mine], items.sets[other]) >= similar
                if exact:
                    alike &= (strips(part, window)[mine] == items.words[other]).all(1)
                doc.append(row[alike])
                item.append(items.owner[other[alike]])
            if doc and sum(map(len, doc)):
                pairs = np.unique(np.concatenate(doc) * len(items.ids) + np.concatenate(item))
                keys = batch.column(0).take(pa.array(pairs // len(items.ids)))
                yield pa.RecordBatch.from_arrays([keys, pa.array([items.ids[k] for k in pairs % len(items.ids)], pa.int64())], ["doc", "item"])

    return match


def leaked_items(
    documents: DataFrame,
    items: DataFrame,
    window: int = 12,
    shingle: int = 5,
    radius: int = 3,
    similar: float = 0.8,
    exact: bool = True,
    words_at_once: int = 200_000,
) -> DataFrame:
    """(doc, item) for documents (doc, text) and items (item bigint, text), each pair once.

    exact: a window counts only if all its words are equal, i.e. the two texts share ``window`` consecutive words.
    """
    assert 0 < shingle <= window
    kind = documents.schema["doc"].dataType.simpleString()
    hashed = documents.select("doc", word_hashes(F.col("text")).alias("w")).where(F.size("w") >= window)
    found = None
    for ids, words in _blocks(items, words_at_once):
        index = documents.sparkSession.sparkContext.broadcast(ItemWindows(ids, words, window, shingle, radius))
        part = hashed.mapInArrow(_matching(index, similar, exact), f"doc {kind}, item bigint")
        found = part if found is None else found.unionByName(part)
    return found.dropDuplicates()


def _blocks(items: DataFrame, words_at_once: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Items and their word hashes, about so many words at a time; one block if there are none. What the driver holds follows the block, not the items."""
    hashed = items.select("item", word_hashes(F.col("text")).alias("w")).dropDuplicates()
    blocks = max(1, -(-(hashed.agg(F.sum(F.size("w"))).first()[0] or 0) // words_at_once))
    for k in range(blocks):
        rows = sorted((tuple(r) for r in hashed.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).collect()), key=lambda r: (r[0] is None, r[0], r[1]))
        yield [r[0] for r in rows], [np.array(r[1], np.int64).view(np.uint64) for r in rows]


# --- whole items, edited ------------------------------------------------------------------------------------------------

#: Ratio of neighbouring sizes of windows; a window is taken at every so many parts of its size.
_RATIO, _STRIDES = 1.12, 16


class WholeItems:
    """Items by classes of size, each indexed by the blocks of their fingerprints."""

    def __init__(self, ids: list, words: list[np.ndarray], shingle: int, radius: int):
        self.ids, self.shingle, self.radius = ids, shingle, radius
        self.sets = [shingles(w, shingle) for w in words]
        held: dict[int, int] = {}
        for s in self.sets:
            for x in np.unique(s).tolist():
                held[x] = held.get(x, 0) + 1
        self.many = max(1, len(words))
        self.known = np.array(sorted(held), np.uint64)
        self.weights = np.log1p(self.many / np.array([held[x] for x in self.known.tolist()], float)) if held else np.empty(0)
        self.classes: dict[int, list[int]] = {}
        for k, s in enumerate(self.sets):
            if len(s):
                self.classes.setdefault(int(round(_RATIO ** round(np.log(len(s)) / np.log(_RATIO)))), []).append(k)
        self.tables = {}
        for size, members in self.classes.items():
            prints = np.concatenate([_prints(_sums(self.sets[k]), np.array([0]), len(self.sets[k])) for k in members])
            tables = []
            for values in block_values(prints, radius + 1):
                order = np.argsort(values, kind="stable")
                tables.append((order, values[order]))
            self.tables[size] = prints, tables

    def weight(self, s: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(s.shape, np.log1p(self.many))
        at = np.minimum(np.searchsorted(self.known, s), len(self.known) - 1)
        return np.where(self.known[at] == s, self.weights[at], np.log1p(self.many))

    def similarity(self, item: int, window: np.ndarray) -> float:
        a, b = np.unique(self.sets[item]), np.unique(window)
        common = self.weight(np.intersect1d(a, b)).sum()
        return float(common / max(self.weight(a).sum() + self.weight(b).sum() - common, 1e-12))

    def found(self, flat: np.ndarray, ends: np.ndarray, similar: float) -> set[tuple[int, int]]:
        """(text, item): items with a window of their own size, in one of many texts' shingles, that is similar enough. ends: where the texts begin and end."""
        out: set[tuple[int, int]] = set()
        sums = _sums(flat)
        begin, end = ends[:-1], ends[1:]
        lengths = end - begin
        owner = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(flat)) - begin[owner]
        for size, (prints, tables) in self.tables.items():
            stride = max(1, size // _STRIDES)
            fits = lengths >= size
            regular = np.flatnonzero((place % stride == 0) & (place + size <= lengths[owner]))
            # The last window of each text, and the whole of a shorter one.
            starts = np.concatenate((regular, end[fits] - size, begin[~fits & (lengths > 0)]))
            stops = np.concatenate((regular + size, end[fits], end[~fits & (lengths > 0)]))
            mine = np.packbits(sums[stops] - sums[starts] > 0, axis=1).view(np.uint64).ravel()
            pairs = []
            for (order, there), values in zip(tables, block_values(mine, self.radius + 1)):
                low, high = np.searchsorted(there, values, "left"), np.searchsorted(there, values, "right")
                many = high - low
                window = np.repeat(np.arange(len(mine)), many)
                first = np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many)
                member = order[first + np.arange(len(window))]
                near = np.bitwise_count(mine[window] ^ prints[member]) <= self.radius
                pairs.append(window[near] * len(prints) + member[near])
            both = np.unique(np.concatenate(pairs))
            for window, k in zip((both // len(prints)).tolist(), (both % len(prints)).tolist()):
                text, item = int(owner[starts[window]]), self.classes[size][k]
                s, at = flat[begin[text] : end[text]], int(starts[window] - begin[text])
                n = min(len(self.sets[item]), len(s))
                around = stride + abs(n - size)
                if (text, item) not in out and any(self.similarity(item, s[b : b + n]) >= similar for b in range(max(0, at - around), min(len(s) - n, at + around) + 1)):
                    out.add((text, item))
        return out


def _sums(s: np.ndarray) -> np.ndarray:
    """Running votes of the bits of shingle hashes."""
    bits = np.unpackbits(s.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
    out = np.zeros((len(s) + 1, 64), np.int32)
    np.cumsum(bits * 2 - 1, axis=0, out=out[1:])
    return out


def _prints(sums: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of the windows of a size at some places."""
    return np.packbits(sums[starts + size] - sums[starts] > 0, axis=1).view(np.uint64).ravel()


def _near(shared, similar: float):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: WholeItems = shared.value
        overlap = 2 * max(map(len, items.sets), default=0) + 64
        for batch in batches:
            lists = batch.column(1)
            ends = np.asarray(lists.offsets) - np.asarray(lists.offsets)[0]
            flat = np.asarray(lists.flatten()).view(np.uint64)
            met: set[tuple[int, int]] = set()
            held, rows, size = [], [], 0

            def weigh() -> None:
                if held and items.tables:
                    found = items.found(np.concatenate(held), np.cumsum([0, *map(len, held)]), similar)
                    met.update((rows[text], item) for text, item in found)

            for k in range(batch.num_rows):
                s = shingles(flat[ends[k] : ends[k + 1]], items.shingle)
                # A very long text is cut into overlapping pieces, so that no window is.
                for at in range(0, max(1, len(s) - overlap), _CHUNK):
                    held.append(s[at : at + _CHUNK + overlap])
                    rows.append(k)
                    size += len(held[-1])
                    if size >= _CHUNK:
                        weigh()
                        held, rows, size = [], [], 0
            weigh()
            order = sorted(met)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k for k, _ in order], pa.int64())), pa.array([items.ids[i] for _, i in order], pa.int64())], ["doc", "item"])

    return match


def near_items(documents: DataFrame, items: DataFrame, shingle: int = 5, radius: int = 14, similar: float = 0.8, words_at_once: int = 200_000) -> DataFrame:
    """(doc, item) for documents (doc, text) that hold a whole item (item bigint, text), edited or not: a window of the item's own number of shingles whose weighted
    Jaccard similarity with the item is at least ``similar``.

    All fingerprints within ``radius`` bits are found; a window as similar as 0.8 lies within about 10 bits, so that a radius of 14 leaves out few (measured against brute
    force in the tests). Items and documents of fewer words than a shingle match nothing; a document shorter than the item is one window.
    """
    kind = documents.schema["doc"].dataType.simpleString()
    hashed = documents.select("doc", word_hashes(F.col("text")).alias("w")).where(F.size("w") >= shingle)
    found = None
    for ids, words in _blocks(items, words_at_once):
        index = documents.sparkSession.sparkContext.broadcast(WholeItems(ids, words, shingle, radius))
        part = hashed.mapInArrow(_near(index, similar), f"doc {kind}, item bigint")
        found = part if found is None else found.unionByName(part)
    return found.dropDuplicates()
