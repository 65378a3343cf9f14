"""Records by id from a web service, as a batch data source: batches of ids, with retries, pacing and a report.

``spark.dataSource.register(BatchFetch)``, then ``spark.read.format("batch_fetch").option("ids", "1,2,3").load()``. The service allows so many
requests a second from all machines together, so batches are dealt to ``streams`` tasks (one, unless asked otherwise), each of which pauses between its
own. The opener is a parameter of `fetched`, so that tests need no network; option ``answers`` names a folder of files <first id>.xml to read instead.
"""

from __future__ import annotations

import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import ids as I
from . import markup

# Address and parameters of the service.
SERVICE = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/efetch.fcgi"
PARAMETERS = {"db": "pubmed", "retmode": "xml"}
SCHEMA = "batch int, requested int, attempts int, seconds double, path string, content binary"


def open_url(url: str, timeout: float) -> bytes:
    with urllib.request.urlopen(url, timeout=timeout) as answer:  # noqa: S310
        return answer.read()


def fetched(wanted: list[str], opener: Callable[[str, float], bytes] = open_url, timeout: float = 30, attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> tuple[bytes, int]:
    """The answer for one batch and how many attempts it took; after a failure it waits 1, 2, 4, at most 8 seconds."""
    for attempt in range(1, max(1, attempts) + 1):
        try:
            return opener(f"{SERVICE}?{urllib.parse.urlencode(PARAMETERS | {'id': ','.join(wanted)})}", timeout), attempt
        except OSError as error:
            if attempt >= attempts:
                raise RuntimeError(f"no answer after {attempt} attempts: {error}") from error
            sleep(min(8.0, 2.0 ** (attempt - 1)))
    raise RuntimeError("no attempt was made")


class BatchFetch(DataSource):
    @classmethod
    def name(cls) -> str:
        return "batch_fetch"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        given = [x.strip() for x in options.get("ids", "").split(",") if x.strip()]
        if wrong := [x for x in given if not x.isdigit()]:
            raise ValueError(f"no ids: {wrong[:5]}")
        self.ids, self.size, self.streams = list(dict.fromkeys(given)), max(1, int(options.get("batch_size", "100"))), max(1, int(options.get("streams", "1")))
        self.pause, self.timeout, self.attempts, self.answers = float(options.get("pause", "0.35")), float(options.get("timeout", "30")), int(options.get("attempts", "3")), options.get("answers")

    def partitions(self) -> list[InputPartition]:
        batches = [(k // self.size, self.ids[k : k + self.size]) for k in range(0, len(self.ids), self.size)]
        return [InputPartition(batches[k :: self.streams]) for k in range(min(self.streams, len(batches)))] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        opener = open_url if self.answers is None else lambda url, _: Path(self.answers, f"{urllib.parse.parse_qs(url.partition('?')[2])['id'][0].partition(',')[0]}.xml").read_bytes()
        for k, (number, batch) in enumerate(partition.value):
            if k:
                time.sleep(self.pause)
            began = time.monotonic()
            content, attempts = fetched(batch, opener, self.timeout, self.attempts)
            yield number, len(batch), attempts, time.monotonic() - began, f"batch_{number}", content


def fetch_documents(spark: SparkSession, wanted: list[str], **options: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents in the order asked for, missing ids (id, pos), report by batch: requested, returned, missing, attempts, seconds)."""
    spark.dataSource.register(BatchFetch)
    once = list(dict.fromkeys("".join(c for c in w if c.isdigit()) for w in wanted))
    asked = [w for w in once if w]
    if not asked:
        raise ValueError("no id was given")
    size = max(1, int(options.get("batch_size", "100")))
    request = spark.createDataFrame(list(enumerate(asked)), "pos int, id string")
    # Answers are kept for this call's results: the service is asked once.
    answers = spark.read.format("batch_fetch").options(ids=",".join(asked), **options).load().persist()
    documents = markup.documents_of(answers)
    ordered = I.in_requested_order(request, documents)
    missing = I.missing(request, documents.select(F.col("pmid").alias("id")).where(F.col("id").isNotNull()).distinct())
    got = ordered.groupBy(F.floor(F.col("pos") / size).cast("int").alias("batch")).agg(F.count("*").alias("returned"))
    report = answers.select("batch", "requested", "attempts", "seconds").join(got, "batch", "left").withColumn("returned", F.coalesce("returned", F.lit(0))).withColumn("missing", F.col("requested") - F.col("returned"))
    return ordered, missing, report


def fetch_from_text(spark: SparkSession, text: str, **options: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`fetch_documents` for the ids that stand in a text, such as a list or a README."""
    rows = I.ids_in_text(spark.createDataFrame([(0, text)], "k int, text string"), "k", "text")
    found = [r["id"] for r in rows.orderBy("pos").collect()]
    if not found:
        raise ValueError("the text holds no id")
    return fetch_documents(spark, found, **options)


def sorted_uploads(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents of the XML files, ids of the others) from files (path, content): XML is told by its first sign, behind a byte order mark and blanks."""
    start = F.regexp_replace(F.decode(F.substring("content", 1, 200), "UTF-8"), "^[\ufeff\\s]+", "")
    kinds = files.withColumn("markup", start.startswith("<"))
    return markup.documents_of(kinds.where("markup")), I.ids_in_files(kinds.where("NOT markup"))
