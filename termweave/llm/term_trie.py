"""How often every distinct term occurs in a collection, and in how many records.

Each task counts into a burst trie: inner nodes route a term by its first characters, containers at the leaves
hold the rest of the term with two counters (occurrences, records). A container that outgrows its limit bursts into a
node and one container for each next character, so that the routing prefixes are as long as the terms at hand need and no longer.
A trie that holds too many terms is handed on and begun anew; memory is bounded whatever the task reads. What a
task hands on are its leaf subtrees, each under its prefix, written once.

Matching subtrees of all tasks are then merged. Two tasks may burst at different depths, so the subtrees are cut to common routes first: how many
terms the subtrees hold below each prefix is summed (a few short prefixes a task), a prefix that holds more than its share is lengthened by one character,
again and again, and every subtree goes to the longest route that leads to it, split where it is shorter than its routes. A route holds a bounded
share of all terms, however frequent its prefix; the worker it meets on merges its subtrees in one trie, route by route, and gives each term once.

Defined results. Equal rows count once. A record that stands with several abstracts counts once for each term of any of them, its occurrences in
all. Null and empty abstracts hold no term but count as records; rows without record id form one record. An empty table gives no row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, term_list
from ..plans.stage import written

SEAM = "\x01"
SUBTREES = "prefix string, rests array<string>, occurrences array<bigint>, records array<bigint>"


class BurstTrie:
    """Terms with two counters each."""

    class Leaf(dict):
        """rest of the term -> [occurrences, records]"""

    def __init__(self, limit: int = 512):
        self.limit, self.root, self.terms = limit, self.Leaf(), 0

    def add(self, term: str, occurrences: int, records: int) -> None:
        above, step, node, depth = None, "", self.root, 0
        while type(node) is not BurstTrie.Leaf:
            step = term[depth : depth + 1]
            above, node = node, node.get(step)
            if node is None:
                node = above[step] = BurstTrie.Leaf()
            depth += len(step)
            if not step:
                break
        rest = term[depth:]
        if (cell := node.get(rest)) is not None:
            cell[0] += occurrences
            cell[1] += records
            return
        node[rest] = [occurrences, records]
        self.terms += 1
        if len(node) > self.limit:
            burst: dict[str, BurstTrie.Leaf] = {}
            for tail, cell in node.items():
                burst.setdefault(tail[:1], BurstTrie.Leaf())[tail[1:]] = cell
            if above is None:
                self.root = burst
            else:
                above[step] = burst

    def leaves(self) -> Iterator[tuple[str, BurstTrie.Leaf]]:
        """Every container under the prefix that leads to it."""
        open_nodes = [("", self.root)]
        while open_nodes:
            prefix, node = open_nodes.pop()
            if type(node) is BurstTrie.Leaf:
                yield prefix, node
            else:
                open_nodes += ((prefix + step, below) for step, below in node.items())


def _rows(trie: BurstTrie) -> pa.RecordBatch:
    prefixes, rests, first, second, ends = [], [], [], [], [0]
    for prefix, leaf in trie.leaves():
        prefixes.append(prefix)
        rests += leaf
        first += (c[0] for c in leaf.values())
        second += (c[1] for c in leaf.values())
        ends.append(len(rests))
    offsets = pa.array(ends, pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x, kind)) for x, kind in ((rests, pa.string()), (first, pa.int64()), (second, pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.array(prefixes, pa.string()), *lists], ["prefix", "rests", "occurrences", "records"])


def _counter(limit: int, most: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = BurstTrie(limit)
        record, held = None, set()  # the record at hand and the terms it has been counted for
        for batch in batches:
            inside: Counter = Counter()
            lists = [x.split(SEAM) for x in batch.column(1).to_pylist()]
            for key, terms in zip(batch.column(0).to_pylist(), lists):
                if key != record or not held:
                    record, held = key, set(terms)
                    inside.update(held)
                else:
                    fresh = set(terms) - held
                    inside.update(fresh)
                    held |= fresh
            for term, n in Counter(chain.from_iterable(lists)).items():
                trie.add(term, n, inside[term])
            if trie.terms > most:
                yield _rows(trie)
                trie = BurstTrie(limit)
        if trie.terms:
            yield _rows(trie)

    return count


#: Routes a worker's partition is cut into, about; longest route.
SHARES, DEEPEST = 4, 24


def routes(subtrees: DataFrame, parts: int) -> set[str]:
    """Prefixes that hold more than their share of all terms, each longer than a hot one by one character: at most parts x SHARES x DEEPEST short strings."""
    sizes = subtrees.select("prefix", F.size("rests").cast("bigint").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    share = max(1000, total // (parts * SHARES))
    if total <= share:
        return set()
    steps = F.transform(F.sequence(F.lit(0), F.least(F.length("prefix"), F.lit(DEEPEST))), lambda k: F.substring("prefix", F.lit(1), k))
    heavy = sizes.select(F.explode(steps).alias("prefix"), "n").groupBy("prefix").agg(F.sum("n").alias("n")).where(F.col("n") > share)
    return {r["prefix"] for r in heavy.select("prefix").collect()}


def _routing(hot: set[str]):
    def route(term: str) -> str:
        depth = 0
        while depth < len(term) and term[:depth] in hot:
            depth += 1
        return term[:depth]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list[list]] = {}
            for prefix, rests, first, second in zip(*(batch.column(i).to_pylist() for i in range(4))):
                whole = route(prefix)
                for rest, o, r in zip(rests, first, second):
                    # Below a hot prefix that is as long as the subtree's own, the terms themselves tell the route.
                    to = whole if len(whole) < len(prefix) else route(prefix + rest)
                    cell = out.setdefault(to, [[], [], []])
                    cell[0].append((prefix + rest)[len(to) :])
                    cell[1].append(o)
                    cell[2].append(r)
            ends = pa.array(np.cumsum([0, *(len(c[0]) for c in out.values())]), pa.int32())
            columns = [pa.ListArray.from_arrays(ends, pa.array([x for c in out.values() for x in c[i]], kind)) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), *columns], ["prefix", "rests", "occurrences", "records"])

    return cut


def _merging(limit: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        route, trie = None, BurstTrie(limit)

        def merged() -> pa.RecordBatch:
            cells = [(route + prefix + rest, c[0], c[1]) for prefix, leaf in trie.leaves() for rest, c in leaf.items()]
            columns = [pa.array([c[i] for c in cells], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, ["term", "total_frequency", "document_frequency"])

        for batch in batches:
            for prefix, rests, first, second in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if prefix != route:
                    if trie.terms:
                        yield merged()
                    route, trie = prefix, BurstTrie(limit)
                for rest, o, r in zip(rests, first, second):
                    trie.add(rest, o, r)
        if trie.terms:
            yield merged()

    return merge


def term_counts(records: DataFrame, limit: int = 512, most: int = 300_000) -> DataFrame:
    """(term, total_frequency, document_frequency) over rows of (record_id, paragraphs: array<string>).

    limit: terms in a container before it bursts; most: terms a task holds before it hands its trie on.
    """
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.array_join("paragraphs", "\n")
    # One shuffle, by record; the copies of a row and the abstracts of a record then lie side by side.
    once = records.select("record_id", "paragraphs").repartition("record_id").dropDuplicates()
    terms = once.select("record_id", fold(F.array_join(term_list(text), SEAM)).alias("terms")).where(F.col("terms") != "")
    subtrees = written(terms.sortWithinPartitions("record_id").mapInArrow(_counter(limit, most), SUBTREES))
    hot = routes(subtrees, parts)
    routed = subtrees.mapInArrow(_routing(hot), SUBTREES).repartition(parts, "prefix").sortWithinPartitions("prefix")
    return routed.mapInArrow(_merging(limit), "term string, total_frequency bigint, document_frequency bigint")


def usefulness(frequency: Column, total: Column, rare_below: int = 3, common_above: float = 0.3) -> Column:
    """``rare``, ``common`` or ``keep``."""
    return F.when(frequency < rare_below, "rare").when(frequency > common_above * total, "common").otherwise("keep")


def marked_counts(records: DataFrame, rare_below: int = 3, common_above: float = 0.3) -> DataFrame:
    """Term counts with a mark for too rare and too common; the share is of all records, with or without terms."""
    total = records.agg(F.countDistinct("record_id").alias("n")).first()["n"]
    return term_counts(records).withColumn("mark", usefulness(F.col("document_frequency"), F.lit(float(total)), rare_below, common_above))
