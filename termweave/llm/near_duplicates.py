"""Records that share most of their content, found without comparing each with each.

A record is the set of its runs of ``run`` consecutive terms; two records are similar by the Jaccard index of their sets.

1. Equal sets are one class: copies are counted together before anything is joined.
2. A count sketch over all classes estimates how many classes hold a run. Its size follows the number of classes up to a fixed bound. All sets are
   ordered by (estimate, hash), one order for the whole collection, rare runs first.
3. Two sets that overlap in o runs share at least l of them within their first n - o + l, for any l. Each class chooses its own l:
   a longer prefix costs more postings to join, but then l shared runs instead of one are needed before a pair is verified. The estimate
   of both costs comes from the sketch. A pair goes by the smaller l of the two, whose prefix both have sent.
4. Pairs with enough shared prefix runs, each within the prefix that the two sizes allow, are verified on the whole sets.

A run that many classes send is dealt into chunks, and every chunk meets every chunk as a key of its own, so that no run is one task's work; so are the
members of a class of many copies when pairs of records are written out.

No result depends on the estimates: they only order the runs, choose the prefixes and deal out the work.

Defined results. Null paragraphs and null or empty abstracts hold no run and match nothing. Equal rows count once. Records with a null id are left
out. A record id that stands with several abstracts is similar to a record if one of them is, and has a class for each. A run never crosses paragraphs.
Runs are compared by hashes of 40 bits, classes by hashes of 64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded_terms
from ..plans.stage import settled
from .leakage import _mixed, shingles

#: Counters of the sketch: 8 for each class, within these bounds. A task counts each up to 65,535. On the driver and in the tasks a counter is
#: one byte, twelve steps to a doubling, so at most 16 MB whatever the collection.
LEAST_SKETCH, LARGEST_SKETCH = 1 << 16, 1 << 24
_STEPS = 12
_SLICES = 16
_FAN = 64  # sketches merged at once
#: Postings of a run, and members of a class, that meet in one task.
HOT = 4096
_BYTES = 5  # of a run's hash in a stored set
_LONGEST = 8  # largest l
_VERIFY = 12.0  # cost of verifying a pair, in joined postings
_SEND = 4.0  # cost of sending a posting, in joined postings

SETS = "record_id bigint, first bigint, second bigint, n int, runs binary"


def _packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :_BYTES]).tobytes()


def _unpacked(cells: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All values of many packed sets, and their ends."""
    raw = np.frombuffer(b"".join(cells), np.uint8).reshape(-1, _BYTES)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :_BYTES] = raw
    return wide.view(np.uint64).ravel(), np.cumsum([0, *(len(c) // _BYTES for c in cells)])


def _building(run: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                paragraphs = part.column(1)
                words = paragraphs.flatten()
                ends = np.asarray(paragraphs.offsets)
                ends = ends - ends[0]
                cuts = np.asarray(words.offsets)
                cuts = cuts - cuts[0]
                flat = np.asarray(words.flatten()).view(np.uint64)
                if len(flat) < run:
                    continue
                hashed = shingles(flat, run) >> np.uint64(64 - 8 * _BYTES)
                start = np.arange(len(hashed))
                paragraph = np.searchsorted(cuts, start, "right") - 1
                inside = start + run <= cuts[paragraph + 1]
                record = np.searchsorted(ends, paragraph[inside], "right") - 1
                hashed = hashed[inside]
                both = np.unique((record.astype(np.uint64) << np.uint64(8 * _BYTES)) | hashed)
                record = (both >> np.uint64(8 * _BYTES)).astype(np.int64)
                values = both & np.uint64((1 << (8 * _BYTES)) - 1)
                ids, begin, n = np.unique(record, return_index=True, return_counts=True)
                if not len(ids):
                    continue
                mixed = _mixed(values)
                first, second = np.add.reduceat(mixed, begin), np.bitwise_xor.reduceat(_mixed(mixed + np.uint64(run)), begin)
                raw = _packed(values)
                cells = [raw[b * _BYTES : (b + k) * _BYTES] for b, k in zip(begin.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(ids)), pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), pa.array(n.astype(np.int32)), pa.array(cells, pa.binary())],
                    ["record_id", "first", "second", "n", "runs"],
                )

    return build


def run_sets(records: DataFrame, run: int = 3) -> DataFrame:
    """One row of ``SETS`` for each row of (record_id, paragraphs) that holds a run; first and second tell a set from others."""
    words = F.transform(F.filter("paragraphs", lambda p: p.isNotNull()), lambda p: F.transform(folded_terms(p), lambda w: F.xxhash64(w)))
    rows = records.where(F.col("record_id").isNotNull() & F.col("paragraphs").isNotNull()).select(F.col("record_id").cast("bigint"), words.alias("words"))
    return rows.mapInArrow(_building(run), SETS)


def _bucket(values: np.ndarray, size: int) -> np.ndarray:
    return (_mixed(values) & np.uint64(size - 1)).astype(np.int64)


def _counting(size: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, held = None, [], 0
        for batch in batches:
            values, _ = _unpacked(batch.column(0).to_pylist())
            waiting.append(_bucket(values, size))
            held += len(values)
            if held > size:
                found = np.bincount(np.concatenate(waiting), minlength=size)
                total, waiting, held = found if total is None else total + found, [], 0
        if waiting:
            found = np.bincount(np.concatenate(waiting), minlength=size)
            total = found if total is None else total + found
        if total is not None:
            parts = np.minimum(total, 65535).astype(np.uint16).reshape(_SLICES, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "counts"])

    return count


def _total(table, cells: int) -> np.ndarray:
    """The sum of counters of two or four bytes."""
    return sum(np.frombuffer(c, np.uint16 if len(c) == 2 * cells else np.int32).astype(np.int64) for c in table.column("counts").to_pylist())


def _adding(cells: int, last: bool):
    def add(key, table):
        total = _total(table, cells)
        counts = np.minimum(np.round(_STEPS * np.log2(1.0 + total)), 255).astype(np.uint8) if last else np.minimum(total, 2**31 - 1).astype(np.int32)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([counts.tobytes()], pa.binary())})

    return add


def sketch(classes: DataFrame) -> np.ndarray:
    """How many classes hold a run of each bucket, in steps of a twelfth of a doubling: an upper estimate for each run, over all classes."""
    rows = classes.count()
    size = LEAST_SKETCH
    while size < min(LARGEST_SKETCH, 8 * rows):
        size *= 2
    parts = classes.select("runs").mapInArrow(_counting(size), "part int, counts binary")
    tasks = classes.rdd.getNumPartitions()
    while tasks > _FAN:  # a tree, so that no task holds more than a few slices
        group = F.floor(F.spark_partition_id() / _FAN).alias("of")
        parts = parts.select("part", "counts", group).groupBy("part", "of").applyInArrow(_adding(size // _SLICES, False), "part int, counts binary")
        tasks = -(-tasks // _FAN)
    found = parts.groupBy("part").applyInArrow(_adding(size // _SLICES, True), "part int, counts binary").collect()
    out = np.zeros((_SLICES, size // _SLICES), np.uint8)
    for part, counts in found:
        out[part] = np.frombuffer(counts, np.uint8)
    return out.ravel()


def _chunked(token: np.ndarray, own: np.ndarray, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, role) of every copy of a posting: role 1 meets as the smaller set, 2 as the larger, 3 as both.

    A run of c chunks has c x c keys. A posting of chunk k stands left at the keys (k, j) and right at (i, k), so that every pair meets at one key.
    """
    plain = np.flatnonzero(chunks <= 1)
    rows, keys, roles = [plain], [token[plain].astype(np.uint64)], [np.full(len(plain), 3)]
    for k in np.flatnonzero(chunks > 1).tolist():
        c, mine = int(chunks[k]), int(own[k] % np.uint64(chunks[k]))
        others = np.array([j for j in range(c) if j != mine], np.uint64)
        base = np.uint64(token[k]) + np.uint64(1 << 32)
        cells = np.concatenate((np.uint64(mine) * np.uint64(c) + others, others * np.uint64(c) + np.uint64(mine), [np.uint64(mine * c + mine)]))
        rows.append(np.full(len(cells), k))
        keys.append(_mixed(base * np.uint64(1 << 20) + cells) & np.uint64(0xFFFFFFFF))
        roles.append(np.concatenate((np.full(c - 1, 1), np.full(c - 1, 2), [3])))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(roles)


def _posting(shared, threshold: float, hot: int):
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = shared.value
        counts = 2.0 ** (np.arange(256) / _STEPS) - 1.0
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                values, ends = _unpacked(part.column(1).to_pylist())
                n = np.diff(ends)
                record = np.repeat(np.arange(len(n)), n)
                step = steps[_bucket(values, len(steps))]
                order = np.lexsort((values, step, record))
                values, cost = values[order], counts[step[order]]
                place = np.arange(len(values)) - ends[record]
                # What a prefix of length p costs: the estimated postings it meets. A partner of equal size sets the length.
                upto = np.concatenate(([0.0], np.cumsum(cost)))
                least = np.ceil(2 * threshold / (1 + threshold) * n - 1e-9).astype(np.int64)
                best, chosen = np.full(len(n), np.inf), np.ones(len(n), np.int64)
                for level in range(1, _LONGEST + 1):
                    length = np.minimum(n - least + level, n)
                    price = (upto[ends[:-1] + length] - upto[ends[:-1]]) * (1 + _VERIFY / level) + _SEND * length
                    better = (price < best) & (level <= least)
                    best[better], chosen[better] = price[better], level
                longest = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + chosen
                sent = place < longest[record]
                owner, place, token = record[sent], place[sent], values[sent] & np.uint64(0xFFFFFFFF)
                ids = np.asarray(part.column(0))
                copy, key, role = _chunked(token, _mixed(ids[owner].view(np.uint64)), np.ceil(cost[sent] / hot).astype(np.int64))
                owner, place = owner[copy], place[copy]
                packed = (n[owner] << 32) | (place << 8) | (role << 4) | chosen[owner]
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.uint32).view(np.int32)), pa.array(ids[owner]), pa.array(packed)], ["token", "id", "packed"])

    return post


def _verifying(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                left, le = _unpacked(part.column(2).to_pylist())
                right, re = _unpacked(part.column(3).to_pylist())
                high = np.uint64(8 * _BYTES)
                a, b = np.diff(le), np.diff(re)
                keys = [np.repeat(np.arange(len(x), dtype=np.uint64), x) << high for x in (a, b)]
                both = np.sort(np.concatenate((keys[0] | left, keys[1] | right)))
                twice = both[1:][both[1:] == both[:-1]] >> high
                common = np.bincount(twice.astype(np.int64), minlength=len(a))
                similarity = common / np.maximum(a + b - common, 1)
                kept = pa.array(similarity >= threshold - 1e-12)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(kept), part.column(1).filter(kept), pa.array(similarity).filter(kept)], ["a", "b", "similarity"])

    return verify


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def candidates(classes: DataFrame, threshold: float, hot: int = HOT) -> DataFrame:
    """(a, b): pairs of classes with enough shared prefix runs, over rows (id, runs); written to the checkpoint folder.

    The postings are shuffled and sorted by run once and kept; both sides of the join read them from there.
    """
    shared = classes.sparkSession.sparkContext.broadcast(sketch(classes))
    sent = classes.select("id", "runs").mapInArrow(_posting(shared, threshold, hot), "token int, id bigint, packed bigint")
    posts = sent.repartition(_partitions(classes), "token").sortWithinPartitions("token").persist(StorageLevel.MEMORY_AND_DISK)
    low = F.col("packed").bitwiseAND(F.lit(0xFF))
    side = posts.select("token", "id", F.shiftright("packed", 32).alias("n"), F.shiftright("packed", 8).bitwiseAND(F.lit(0xFFFFFF)).alias("place"), low.bitwiseAND(F.lit(15)).alias("level"), F.shiftright(low, 4).alias("role"))
    x, y = side.where(F.col("role").bitwiseAND(F.lit(1)) > 0).alias("x"), side.where(F.col("role").bitwiseAND(F.lit(2)) > 0).alias("y")
    overlap = F.ceil(threshold / (1 + threshold) * (F.col("x.n") + F.col("y.n")) - 1e-9)
    level = F.least("x.level", "y.level")
    # The smaller set stands left; of equal sizes, the smaller id.
    smaller = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.id") < F.col("y.id")))
    alike = F.col("x.n") >= threshold * F.col("y.n") - 1e-9
    within = (F.col("x.place") < F.col("x.n") - overlap + level) & (F.col("y.place") < F.col("y.n") - overlap + level)
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & smaller & alike & within)
    pairs = met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), level.alias("level")).groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("level").alias("level"))
    found = settled(pairs.where(F.col("shared") >= F.col("level")).select("a", "b"))
    posts.unpersist()
    return found


def similar_classes(records: DataFrame, threshold: float, run: int = 3, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (record_id, set, class_id) of every record with a run, a row for each different set of it, where class_id is the least
    record with an equal set; links (a, b, similarity) between sets.

    Both are written to the checkpoint folder. What is kept in between is recomputed if an executor is lost, and let go at the end.
    Runs travel once, by set; the postings and the pairs to verify come to them.
    """
    rows = run_sets(records, run).select("record_id", F.col("first").alias("set"), "runs").persist(StorageLevel.MEMORY_AND_DISK)
    rows.count()  # two branches read them at once; neither should work them out again
    # Copies are taken together where they are read, before the runs travel: by set, along which the pairs are verified too.
    classes = rows.groupBy(F.col("set").alias("id")).agg(F.min("record_id").alias("class_id"), F.first("runs").alias("runs")).persist(StorageLevel.MEMORY_AND_DISK)
    ones = rows.select("record_id", "set").distinct()
    members = settled(ones.join(classes.select(F.col("id").alias("set"), "class_id"), "set").select("record_id", "set", "class_id"))
    rows.unpersist()
    pairs = candidates(classes, threshold, hot)
    left, right = classes.select(F.col("id").alias("a"), F.col("runs").alias("x")), classes.select(F.col("id").alias("b"), F.col("runs").alias("y"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    links = settled(met.mapInArrow(_verifying(threshold), "a bigint, b bigint, similarity double"))
    classes.unpersist()
    return members, links


_SALTS = 32


def _dealt(rows: DataFrame, large: DataFrame, key: str, by: str, name: str) -> DataFrame:
    """The rows with the number of chunks of the class in ``key``, 1 for all but the few large ones. Salted by ``by``, so that a large class is not one task's work."""
    salted = large.select(F.col("set").alias(key), F.col("chunks").alias(name), F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(_SALTS)).cast("int")).join(salted, [key, "salt"], "left")
    return dealt.withColumn(name, F.coalesce(name, F.lit(1))).drop("salt")


def similar_pairs(records: DataFrame, threshold: float = 0.6, run: int = 3, hot: int = HOT) -> DataFrame:
    """(record_id_a, record_id_b), a < b: every pair of similar records, copies included.

    All pairs of copies are asked for. The members of a large class are dealt into chunks, and every two chunks meet under a key of their own.
    """
    members, links = similar_classes(records, threshold, run, hot)
    large = members.groupBy("set").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("set", F.ceil(F.col("n") / hot).cast("int").alias("chunks"))
    several = members.groupBy("record_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("record_id"), F.lit(True).alias("several"))
    dealt = _dealt(members.select("record_id", "set"), large, "set", "record_id", "chunks").join(several, "record_id", "left").withColumn("several", F.coalesce("several", F.lit(False)))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64(F.col("record_id"), F.lit(7)), F.col("chunks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    p, q = F.col("record_id").alias("p"), F.col("record_id").alias("q")
    x = dealt.select(p, "set", F.col("chunk").alias("i"), every.alias("j"), F.col("several").alias("ps"))
    y = dealt.select(q, "set", every.alias("i"), F.col("chunk").alias("j"), F.col("several").alias("qs"))
    inside = x.join(y, ["set", "i", "j"]).where(F.col("p") < F.col("q")).select("p", "q", (F.col("ps") | F.col("qs")).alias("twice"))
    ends = _dealt(_dealt(links.select("a", "b"), large, "a", "b", "ca"), large, "b", "a", "cb")
    ends = ends.select("a", "b", F.explode(F.sequence(F.lit(0), F.col("ca") - 1)).alias("i"), "cb").select("a", "b", "i", F.explode(F.sequence(F.lit(0), F.col("cb") - 1)).alias("j"))
    left = dealt.select(p, F.col("set").alias("a"), F.col("chunk").alias("i"), F.col("several").alias("ps"))
    right = dealt.select(q, F.col("set").alias("b"), F.col("chunk").alias("j"), F.col("several").alias("qs"))
    across = ends.join(left, ["a", "i"]).join(right, ["b", "j"]).where(F.col("p") != F.col("q")).select("p", "q", (F.col("ps") | F.col("qs")).alias("twice"))
    both = inside.unionByName(across).select(F.least("p", "q").alias("record_id_a"), F.greatest("p", "q").alias("record_id_b"), "twice")
    # Only records with several abstracts can meet twice.
    return both.where(~F.col("twice")).drop("twice").unionByName(both.where("twice").drop("twice").distinct())


def record_classes(records: DataFrame, threshold: float = 0.6, run: int = 3, hot: int = HOT) -> DataFrame:
    """(record_id, class_id, copies, links): one row for each record that holds a run (for each of its different abstracts, if it has several).

    class_id is the least record with an equal set, copies the size of its class, links the number of other classes similar to it.
    """
    members, links = similar_classes(records, threshold, run, hot)
    sizes = members.groupBy("set", "class_id").agg(F.count("*").alias("copies"))
    ends = links.select(F.explode(F.array("a", "b")).alias("set")).groupBy("set").agg(F.count("*").alias("links"))
    known = sizes.join(ends, "set", "left").select("set", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("copies") > hot, _SALTS - 1).otherwise(0))))
    large = known.where(F.col("copies") > hot).select("set", F.lit(_SALTS).alias("chunks"))
    dealt = _dealt(members, large, "set", "record_id", "chunks").withColumn("salt", F.pmod(F.xxhash64("record_id"), F.col("chunks")).cast("int"))
    return dealt.join(salted, ["set", "salt"]).select("record_id", "class_id", "copies", "links")
