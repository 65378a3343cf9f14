"""Skip-gram with negative sampling over (words: array<string>), trained where the sentences lie.

The words of a partition are taken a few short blocks at a time: the scores of a block's words with all words around them and with the block's noise words are one
matrix product, and so are the gradients. After each epoch the partitions' vectors are averaged, each by the curvature it met there.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a block (or as many as a window spans), blocks of a step, noise words of a block; rows of a model that are merged at once.
BLOCK, STEP, SHARED, ROWS = 16, 16, 16, 4_096
#: Fixed values of the reference's trainer: noise words of a pair, the power that flattens their counts, the first and the last rate.
NEGATIVE, POWER, RATE, LAST_RATE = 5, 0.75, 0.025, 0.0001


def encoded(sentences: DataFrame, words: list[str], partitions: int) -> DataFrame:
    """(ids, lengths): the known words of some sentences as numbers one after another, and how many each sentence has, both as bytes of int32.

    Sentences are dealt out and follow one another by their other columns, or by the words if there are none.
    """
    known = sentences.sparkSession.sparkContext.broadcast(words)

    def encode(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        vocabulary = pa.array(known.value, "string")
        for batch in batches:
            rows = batch.column("words")
            ids = pc.fill_null(pc.index_in(rows.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.fromiter(pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False), "int64", len(rows)))
            kept = np.concatenate([[0], np.cumsum(ids >= 0)])[np.concatenate([[0], ends])]
            yield pa.record_batch([pa.array([x.astype("int32").tobytes()], "binary") for x in (ids[ids >= 0], np.diff(kept))], ["ids", "lengths"])

    order = [c for c in sentences.columns if c != "words"] or ["words"]
    dealt = sentences.repartition(partitions, *order).sortWithinPartitions(*order)
    return dealt.select("words").mapInArrow(encode, "ids binary, lengths binary")


def steps(ids, sentence, window: int, noise, rng):
    """For each step over some sentences, sentence telling to which a word belongs: the words with those around them, noise words by block, and weights of the
    pairs of a block's words with the words around the block and with its noise words."""
    import numpy as np

    block = max(BLOCK, 2 * window)
    wide, length = block + 2 * window, block * STEP
    many = -(-len(ids) // length)
    pad = (window, many * length - len(ids) + window)
    ids, sentence = np.pad(ids, pad), np.pad(sentence, pad, constant_values=-1)
    reach = rng.integers(1, window + 1, len(ids), dtype="int8")
    reach[sentence < 0] = 0
    distance = np.abs(np.arange(block)[:, None] + window - np.arange(wide)).astype("int8")
    distance[distance == 0] = window + 1
    around = np.arange(STEP)[:, None] * block + np.arange(wide)
    for k in range(0, many * length, length):
        at = around + k
        others = np.minimum(np.searchsorted(noise, rng.random((STEP, SHARED), dtype="float32"), side="right"), len(noise) - 1)
        near = sentence[at]
        pairs = ((distance <= reach[at][:, None, :]) & (near[:, window:-window, None] == near[:, None, :])).astype("float32")
        # A noise word is none for a pair that it is itself the word of.
        same = (ids[at][:, :, None] == others[:, None, :]).astype("float32")
        far = (pairs.sum(2, keepdims=True) - pairs @ same) * np.float32(NEGATIVE / SHARED)
        yield ids[k : k + length + 2 * window], others, np.concatenate([pairs, far], 2)


def stepper(model, window: int):
    """A function that goes one step down the gradient for all pairs of a few blocks, as `steps` gives them, and the sums of curvature by row of the model.

    Rows of words come first in the model, rows of words around behind them. A word that stands often in the blocks takes the sum of its gradients, shortened by
    their curvature, as an implicit step is. What a step works with is allocated once.
    """
    import numpy as np
    from numpy.lib.stride_tricks import as_strided

    v, width = len(model) // 2, model.shape[1]
    block = max(BLOCK, 2 * window)
    wide, n, far = block + 2 * window, STEP * block, STEP * SHARED
    near = n + 2 * window
    curved = np.zeros(len(model), "float32")
    rows = np.empty(n + near + far, "int64")
    bend = np.empty(len(rows), "float32")
    taken, gradient, moved, kept = (np.empty((len(rows), width), "float32") for _ in range(4))
    score, curve = (np.empty((STEP, block, wide + SHARED), "float32") for _ in range(2))
    left, right = score[:, :, :wide], score[:, :, wide:]
    inner, noise = np.empty((STEP, block, width), "float32"), gradient[n + near :].reshape(STEP, SHARED, width)
    outer = np.empty((STEP, wide, width), "float32")
    line = taken.strides[0]
    a, c = taken[:n].reshape(STEP, block, width), taken[n + near :].reshape(STEP, SHARED, width)
    b = as_strided(taken[n:], (STEP, wide, width), (block * line, line, taken.itemsize))

    def folded(out):
        """Takes sums by block over the words around and adds them up where those of two blocks overlap."""
        shape, strides = out.shape[1:], (block * out.strides[0], *out.strides)
        body, rest, end = as_strided(out, (STEP, block, *shape), strides), as_strided(out[block:], (STEP, wide - block, *shape), strides), out[n:near]

        def fold(x) -> None:
            body[:] = x[:, :block]
            end[:] = 0
            np.add(rest, x[:, block:], out=rest)

        return fold

    fold_gradient, fold_bend = folded(gradient[n : n + near]), folded(bend[n : n + near])
    places, bits = np.arange(len(rows)), len(rows).bit_length()

    def step(ids, others, weight, rate: float) -> None:
        rows[:n] = ids[window:-window]
        np.add(ids, v, out=rows[n : n + near])
        np.add(others.ravel(), v, out=rows[n + near :])
        np.take(model, rows, 0, out=taken, mode="clip")
        np.matmul(a, b.swapaxes(1, 2), out=left)
        np.matmul(a, c.swapaxes(1, 2), out=right)
        np.negative(score, out=score)
        np.exp(score, out=score)
        np.add(score, 1, out=score)
        np.reciprocal(score, out=score)
        np.multiply(score, score, out=curve)
        np.subtract(score, curve, out=curve)
        np.multiply(curve, weight, out=curve)
        np.subtract(left, 1, out=left)
        np.multiply(score, weight, out=score)
        np.matmul(left, b, out=gradient[:n].reshape(a.shape))
        np.matmul(right, c, out=inner)
        gradient[:n] += inner.reshape(n, width)
        np.matmul(left.swapaxes(1, 2), a, out=outer)
        fold_gradient(outer)
        np.matmul(right.swapaxes(1, 2), a, out=noise)
        sizes = [np.vdot(x, x) / len(x) for x in (taken[n:], taken[:n])]
        down = curve.sum(1) * sizes[1]
        np.multiply(curve.sum(2).ravel(), sizes[0], out=bend[:n])
        fold_bend(down[:, :wide])
        bend[n + near :] = down[:, wide:].ravel()
        keyed = np.sort((rows << bits) | places)
        sorted_rows, order = keyed >> bits, keyed & ((1 << bits) - 1)
        starts = np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]])
        first = np.flatnonzero(starts)
        # In this order the rows of a word lie together: neighbours are added, then sums of two, of four, until the first of each word holds all.
        place, s = places - first[np.cumsum(starts) - 1], 1
        while len(at := np.flatnonzero((place & (2 * s - 1)) == s)):
            gradient[order[at - s]] += gradient[order[at]]
            s *= 2
        own, each = sorted_rows[first], order[first]
        bent = np.add.reduceat(bend[order], first)
        np.take(gradient, each, 0, out=moved[: len(own)], mode="clip")
        np.take(taken, each, 0, out=kept[: len(own)], mode="clip")
        moved[: len(own)] *= (rate / (1 + rate * bent))[:, None].astype("float32")
        kept[: len(own)] -= moved[: len(own)]
        model[own] = kept[: len(own)]
        curved[own] += bent

    return step, curved


def trained(sentences: DataFrame, size: int = 100, window: int = 5, least: int = 1, epochs: int = 20, partitions: int = 1, seed: int = 42) -> DataFrame:
    """(word, vector: array<float>): the vectors of all words that occur ``least`` times, the most frequent word first.

    The driver and each task hold one model, two vectors for each word; what the partitions send is added up on the workers.
    """
    import numpy as np
    import pyarrow as pa

    spark = sentences.sparkSession
    context = spark.sparkContext
    kept = sentences.persist(StorageLevel.DISK_ONLY)
    found = kept.select(F.explode("words").alias("word")).where("word is not null").groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).toArrow()
    names, counts = found.column("word").to_pylist(), found.column("n").to_numpy()
    by = sorted(range(len(names)), key=lambda k: (-counts[k], names[k]))
    words, counts = [names[k] for k in by], counts[by]
    v, total = len(words), int(counts.sum())
    if not v:
        kept.unpersist()
        raise ValueError("no word occurs often enough to be trained")
    model = np.zeros((2 * v, size), "float32")
    model[:v] = (np.random.default_rng(seed).random((v, size), dtype="float32") - np.float32(0.5)) / np.float32(size)
    noise = np.cumsum(counts**POWER)
    noise = (noise / noise[-1]).astype("float32")
    texts = encoded(kept, words, partitions).persist(StorageLevel.DISK_ONLY)
    texts.count()
    kept.unpersist()

    def run(epoch: int, sent):
        def epoch_of(part: int, rows):
            old, noise = sent.value
            here = old.copy()
            step, mass = stepper(here, window)
            rng, done = np.random.default_rng((seed, epoch, part)), 0
            with np.errstate(over="ignore"):
                for row in rows:
                    ids, lengths = (np.frombuffer(x, "int32") for x in (row["ids"], row["lengths"]))
                    for near, others, weight in steps(ids, np.repeat(np.arange(len(lengths)), lengths), window, noise, rng):
                        share = (epoch + min(1.0, done * partitions / total)) / epochs
                        step(near, others, weight, RATE - (RATE - LAST_RATE) * share)
                        done += weight[:, :, 0].size
            here -= old
            here *= mass[:, None]
            for k in range(0, len(here) if done else 0, ROWS):
                yield k, (here[k : k + ROWS], mass[k : k + ROWS])

        return epoch_of

    for epoch in range(epochs):
        sent = context.broadcast((model, noise))
        changed = texts.rdd.mapPartitionsWithIndex(run(epoch, sent)).reduceByKey(lambda x, y: (x[0] + y[0], x[1] + y[1]), partitions)
        for k, (moved, mass) in changed.toLocalIterator():
            model[k : k + len(moved)] += moved / np.maximum(mass, np.float32(1e-30))[:, None]
        # Else the vectors of all epochs stay on disk until the driver happens to collect its garbage.
        changed._jrdd.rdd().cleanShuffleDependencies(True)
        sent.destroy()
    texts.unpersist()
    rows = pa.table({"word": pa.array(words, "string"), "vector": pa.ListArray.from_arrays(pa.array(np.arange(v + 1) * size, "int32"), pa.array(model[:v].ravel()))})
    return spark.createDataFrame(rows, "word string, vector array<float>")
