"""Query expansion: spelling by edit distance, neighbours by cosine, word vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def vocabulary(counts: DataFrame) -> DataFrame:
    """(surface, cf): total frequency by surface form, over (term, cf)."""
    from ..functions.text import surface

    return counts.groupBy(surface(F.col("term")).alias("surface")).agg(F.sum("cf").alias("cf")).where(F.col("surface") != "")


#: Query tokens whose table is sent to every task. A longer one (a file of queries) is joined by length instead.
SENT = 1_000


def spelling_candidates(query: DataFrame, words: DataFrame, most: int = 2, top: int = 5) -> DataFrame:
    """(pos, token, candidate, distance, frequency, rank): vocabulary words near each query token.

    A query table (pos, token) of at most ``SENT`` rows is broadcast; a larger one meets the words by length. Lengths are compared before distances.
    """
    close = F.levenshtein("surface", "token", most) >= 0
    if query.limit(SENT + 1).count() <= SENT:
        met = words.join(F.broadcast(query), (F.abs(F.length("surface") - F.length("token")) <= most) & close)
    else:
        lengths = F.explode(F.sequence(F.greatest(F.length("token") - most, F.lit(0)), F.length("token") + most))
        met = words.withColumn("n", F.length("surface")).join(query.withColumn("n", lengths), "n").where(close)
    rows = met.select("pos", "token", F.col("surface").alias("candidate"), F.levenshtein("surface", "token").alias("distance"), F.col("cf").alias("frequency"))
    order = Window.partitionBy("pos").orderBy("distance", F.desc("frequency"), F.abs(F.length("candidate") - F.length("token")), "candidate")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def corrected(query: DataFrame, words: DataFrame, most: int = 2) -> DataFrame:
    """(pos, token, known, corrected, distance): a known token stays; else the best candidate, else itself."""
    known = query.join(words, query.token == words.surface, "left").select("pos", "token", F.col("surface").isNotNull().alias("known"))
    best = spelling_candidates(query, words, most, 1).select("pos", "candidate", "distance")
    both = known.join(best, "pos", "left")
    word = F.when(F.col("known"), F.col("token")).otherwise(F.coalesce("candidate", "token"))
    return both.select("pos", "token", "known", word.alias("corrected"), F.when(F.col("known"), 0).otherwise(F.col("distance")).alias("distance"))


def joined_query(fixed: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("pos", "corrected")))
    return fixed.agg(F.array_join(F.transform(ordered, lambda x: x["corrected"]), " ").alias("corrected_query"))


def edit_matrix(source: str, target: str) -> list[list[int]]:
    """The table of edit distances between prefixes: one row of the longer word at a time."""
    rows = [list(range(len(target) + 1))]
    for i, a in enumerate(source, 1):
        above, row = rows[-1], [i]
        for j, b in enumerate(target, 1):
            row.append(min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (a != b)))
        rows.append(row)
    return rows


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays, in double precision; null for a zero vector."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


#: Rows of a block of vectors, and queries compared with one at a time.
_BLOCK = 10_000
_CHUNK = 200


def blocked(vectors: DataFrame, queries: DataFrame, work, schema: str, block: int = _BLOCK) -> DataFrame:
    """``work`` over every pair of a block of queries and a block of rows, both (id, vec); a task holds one pair, and nothing is broadcast."""
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    rows, asked = vectors.count(), queries.count()
    a, b = max(1, -(-asked // block)), max(1, -(-rows // block), min(cores, rows // 500))

    def dealt(df: DataFrame, own: str, others: str, n: int, m: int) -> DataFrame:
        kept = df.where(F.col("id").isNotNull() & F.col("vec").isNotNull()).select("id", "vec")
        return kept.select("*", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(others)).groupBy("qb", "vb")

    return dealt(queries, "qb", "vb", a, b).cogroup(dealt(vectors, "vb", "qb", b, a)).applyInArrow(work, schema)


def cosines(left, right):
    """For each few queries of a table: their ids, the ids of all rows, and the cosines in double precision to six places; NaN for a zero vector."""
    import numpy as np

    if not len(left) or not len(right):
        return
    q, v = (np.array(t["vec"].to_pylist(), float) for t in (left, right))
    ids = [t["id"].to_numpy() for t in (left, right)]
    with np.errstate(invalid="ignore", divide="ignore"):
        size = np.sqrt((v * v).sum(1))
        for k in range(0, len(q), _CHUNK):
            part = q[k : k + _CHUNK]
            yield ids[0][k : k + _CHUNK], ids[1], np.round(part @ v.T / (np.sqrt((part * part).sum(1))[:, None] * size), 6) + 0.0


def _table(columns: dict, parts: list):
    import numpy as np
    import pyarrow as pa

    return pa.table({name: pa.array(np.concatenate([p[i] for p in parts]) if parts else [], kind) for i, (name, kind) in enumerate(columns.items())})


def neighbours(vectors: DataFrame, queries: DataFrame, top: int, least: float = -1.0, block: int = _BLOCK) -> DataFrame:
    """(query, neighbour, similarity, rank) over (id, vec), any number of queries: the best ``top`` rows of each block, then of all."""

    def best(left, right):
        import numpy as np

        parts = []
        for asked, ids, near in cosines(left, right):
            near[(ids[None, :] == asked[:, None]) | ~(near >= least)] = -np.inf
            if near.shape[1] > top:
                edge = np.partition(near, near.shape[1] - top, axis=1)[:, near.shape[1] - top]
            else:
                edge = np.full(len(asked), -np.inf)
            i, j = np.nonzero((near >= edge[:, None]) & (near > -np.inf))
            order = np.lexsort((ids[j], -near[i, j], i))
            i, j = i[order], j[order]
            kept = np.arange(len(i)) - np.searchsorted(i, i) < top
            parts.append((asked[i[kept]], ids[j[kept]], near[i[kept], j[kept]]))
        return _table({"query": "int64", "neighbour": "int64", "similarity": "float64"}, parts)

    rows = blocked(vectors, queries, best, "query bigint, neighbour bigint, similarity double", block)
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def similarities(vectors: DataFrame, queries: DataFrame, block: int = _BLOCK) -> DataFrame:
    """(a, b, similarity) of every pair of a query and another row, both (id, vec); a pair of two queries comes once, a < b."""

    def pairs(left, right):
        import numpy as np

        parts = []
        for asked, ids, near in cosines(left, right):
            i, j = np.nonzero(ids[None, :] != asked[:, None])
            parts.append((asked[i], ids[j], near[i, j]))
        return _table({"a": "int64", "b": "int64", "similarity": "float64"}, parts)

    rows = blocked(vectors, queries, pairs, "a bigint, b bigint, similarity double", block)
    twice = rows.join(queries.select(F.col("id").alias("b")).distinct().withColumn("asked", F.lit(True)), "b", "left")
    return twice.where(F.col("asked").isNull() | (F.col("a") < F.col("b"))).select("a", "b", F.nanvl("similarity", F.lit(None).cast("double")).alias("similarity"))


def expanded(near: DataFrame, queries: DataFrame) -> DataFrame:
    """Neighbours of all query words, each once, where first seen; the query's own words are none."""
    first = Window.partitionBy("neighbour").orderBy("query", "rank")
    rows = near.join(queries.select(F.col("id").alias("neighbour")), "neighbour", "left_anti")
    return rows.withColumn("k", F.row_number().over(first)).where("k = 1").select("query", "neighbour", "similarity", "rank")


def pca_2d(near: list[tuple]) -> list[tuple]:
    """(id, x, y) of a word and its few neighbours; signs fixed by the largest loading. A bounded display set, worked out on the driver."""
    import numpy as np

    ids, matrix = [r[0] for r in near], np.array([r[1] for r in near], float)
    centred = matrix - matrix.mean(0)
    _, _, v = np.linalg.svd(centred, full_matrices=False)
    v = v[:2]
    v = v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None]
    flat = centred @ v.T
    return [(i, float(x), float(y) if flat.shape[1] > 1 else 0.0) for i, (x, *rest) in zip(ids, flat.tolist()) for y in (rest or [0.0])]


def pca_maps(vectors: DataFrame, queries: DataFrame, shown: int) -> DataFrame:
    """(query, id, x, y): each query and its ``shown`` nearest rows on a plane of their own."""

    def plane(key, table):
        import pyarrow as pa

        rows = sorted(zip(table["rank"].to_pylist(), table["id"].to_pylist(), table["vec"].to_pylist()))
        flat = pca_2d([(i, v) for _, i, v in rows])
        ids, x, y = zip(*flat)
        return pa.table({"query": pa.array([key[0].as_py()] * len(ids), "int64"), "id": pa.array(ids, "int64"), "x": pa.array(x, "float64"), "y": pa.array(y, "float64")})

    near = neighbours(vectors, queries, shown).select("query", F.col("neighbour").alias("id"), "rank").join(vectors, "id")
    own = queries.select(F.col("id").alias("query"), "id", F.lit(0).alias("rank"), "vec")
    return near.select("query", "id", "rank", "vec").unionByName(own).groupBy("query").applyInArrow(plane, "query bigint, id bigint, x double, y double")


def sentence_words(tokens: DataFrame, least: int = 2) -> DataFrame:
    """(document_id, segment_id, sentence_index, words): surface forms by sentence, for training vectors."""
    rows = tokens.groupBy("document_id", "segment_id", "sentence_index").agg(F.array_sort(F.collect_list(F.struct("word_index", "surface"))).alias("w"))
    return rows.select("document_id", "segment_id", "sentence_index", F.col("w.surface").alias("words")).where(F.size("words") >= least)


def words_by_sentence(docs: DataFrame, least: int = 2) -> DataFrame:
    """What ``sentence_words`` gives for the tokens of (document_id, text), straight from the texts: no index and no shuffle."""
    from ..functions import text as T

    lines = F.filter(F.transform(F.split("text", "\n"), T.normal_statistics), lambda x: x != "")
    rows = docs.select("document_id", F.posexplode(lines).alias("segment_id", "text")).select("document_id", "segment_id", F.posexplode(T.sentence_list(F.col("text"))).alias("sentence_index", "text"))
    terms = rows.select("document_id", "segment_id", "sentence_index", T.term_list(F.col("text")).alias("terms")).where(F.size("terms") >= least)
    # All terms of a sentence in one pass; no term holds the control character used as a seam.
    return terms.select("document_id", "segment_id", "sentence_index", F.split(T.surface(F.array_join("terms", "\x01")), "\x01").alias("words"))


def architecture(name: str) -> str:
    """skip-gram under its usual names; the other architecture has no distributed trainer here."""
    plain = name.strip().lower().replace("-", "").replace("_", "").replace(" ", "")
    if plain in ("skipgram", "sg"):
        return "skipgram"
    if plain in ("cbow", "continuousbagofwords"):
        raise NotImplementedError("continuous bag of words has no distributed trainer")
    raise ValueError(f"unknown architecture {name!r}")


def most_similar(model, word: str, top: int = 10) -> list[tuple[str, float]]:
    """The nearest words of a trained model with their cosines to six places; none for a word it does not know."""
    if not has_word(model, word):
        return []
    return [(r["word"], round(r["similarity"], 6)) for r in model.findSynonyms(normal_word(word), top).collect()]


def normal_word(word: str) -> str:
    return (word or "").lower().replace("ß", "ss").replace("’", "'").strip()


def has_word(model, word: str) -> bool:
    return not model.getVectors().where(F.col("word") == normal_word(word)).isEmpty()


def word_similarity(model, first: str, second: str) -> float | None:
    """The cosine of two words to six places; null if the model does not know both."""
    from pyspark.ml.functions import vector_to_array

    a, b = normal_word(first), normal_word(second)
    known = {r["word"]: r["v"] for r in model.getVectors().where(F.col("word").isin(a, b)).select("word", vector_to_array("vector").alias("v")).collect()}
    if a not in known or b not in known:
        return None
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    size = (dot(known[a], known[a]) * dot(known[b], known[b])) ** 0.5
    return round(dot(known[a], known[b]) / size, 6) if size else None


def shown_neighbours(near: list[tuple[str, float]], word: str, most: int = 12) -> list[tuple[int, str, float]]:
    """(rank, word, similarity) of the neighbours to show: the word itself, blanks and repeats left out, at most ``most``."""
    seen, rows = {normal_word(word)}, []
    for other, similarity in near:
        if (name := normal_word(other)) and name not in seen and len(rows) < most:
            seen.add(name)
            rows.append((len(rows) + 1, other, similarity))
    return rows


def as_model(vectors: DataFrame, params: dict):
    """Spark's own word vector model over (word, vector: array<float>), by way of the form in which Spark saves one."""
    import json
    import time
    import uuid

    from pyspark.ml.feature import Word2VecModel

    from ..plans.stage import checkpoint_folder

    spark, name = vectors.sparkSession, f"Word2Vec_{uuid.uuid4().hex[:12]}"
    path = f"{checkpoint_folder(spark)}/{name}"
    about = {"class": "org.apache.spark.ml.feature.Word2VecModel", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": name, "paramMap": params, "defaultParamMap": {}}
    vectors.write.parquet(f"{path}/data")
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return Word2VecModel.load(path)


def train_vectors(sentences: DataFrame, size: int = 100, window: int = 5, least: int = 1, epochs: int = 20, partitions: int = 1, seed: int = 42, kind: str = "skipgram"):
    """A skip-gram model over (words: array<string>), as Spark's model."""
    from .skipgram import RATE, trained

    architecture(kind)
    params = {"vectorSize": size, "windowSize": window, "minCount": least, "maxIter": epochs, "numPartitions": partitions, "seed": seed, "stepSize": RATE, "maxSentenceLength": 1000, "inputCol": "words", "outputCol": "v"}
    return as_model(trained(sentences, size, window, least, epochs, partitions, seed), params)
