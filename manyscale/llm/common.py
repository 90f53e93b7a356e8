"""What the text operators share: words, stored intermediates, and work on batches of texts."""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from manyscale.plans import shipping, storage

#: The white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """The maximal runs of characters other than ``BLANKS``, in order; none for null."""
    flat = F.coalesce(text, F.lit(""))
    for blank in BLANKS[1:]:  # a search for one character each, several times faster than translate()
        flat = F.replace(flat, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(flat, " "), "")


def lower_ascii(text: Column) -> Column:
    """The text with A-Z, and no other letter, in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def merged(parts: list, rank: Callable) -> list:
    """Neighbours joined again and again, the pair of lowest ``rank(left, right)`` first and of equal ones the leftmost, while one has a rank.

    Pairs wait in a heap and parts know their neighbours, so long strings cost little more for each letter than short ones.
    """
    if len(parts) < 2:
        return parts
    parts, last = list(parts), len(parts)
    after, before = [*range(1, last), -1], [*range(-1, last - 1)]
    waiting = [(r, at, left, right) for at, (left, right) in enumerate(zip(parts, parts[1:])) if (r := rank(left, right)) is not None]
    heapq.heapify(waiting)
    while waiting:
        _, at, left, right = heapq.heappop(waiting)
        then = after[at]
        # A part that was joined since is None or longer.
        if then < 0 or parts[at] != left or parts[then] != right:
            continue
        parts[at], parts[then] = left + right, None
        after[at] = beyond = after[then]
        if beyond >= 0:
            before[beyond] = at
            if (r := rank(parts[at], parts[beyond])) is not None:
                heapq.heappush(waiting, (r, at, parts[at], parts[beyond]))
        if (previous := before[at]) >= 0 and (r := rank(parts[previous], parts[at])) is not None:
            heapq.heappush(waiting, (r, previous, parts[previous], parts[at]))
    return [p for p in parts if p is not None]


def in_portions(texts: list, letters: int = 4_000_000) -> Iterator[list]:
    """The texts in runs of about so many letters; a longer text is a run of its own."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text) > letters:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared checkpoint folder; it is removed when the session ends."""
    path = f"{storage.checkpoint_dir(spark)}/manyscale-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared checkpoint folder and read from there."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def on_texts(docs: DataFrame, work: Callable[[list, list], dict[str, list]], schema: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Apply ``work(ids, texts)`` to Arrow batches of documents; it returns the columns of ``schema``.

    Only the two named columns are read, so clashing names elsewhere do no harm. Null texts arrive as None.
    """
    spark = docs.sparkSession
    shipping.ship(spark)
    pairs = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    fields = arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = work(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in fields], schema=fields)

    return pairs.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def tallied(rows: DataFrame, add: Callable[..., None], schema: str, limit: int = 500_000, size: Callable[[dict], int] = len,
            columns: Callable[[dict], Iterator[list]] | None = None) -> DataFrame:
    """Partial sums of each task: ``add(sums, *columns)`` updates a dict of sums with a batch of ``rows``.

    Each entry becomes a row, key columns first, then its sums, unless ``columns(sums)`` yields the output's columns itself.
    A task gives its sums out and starts anew beyond ``limit`` entries (as ``size`` counts them), so a key may come several times
    and has to be summed up afterwards.
    """
    shipping.ship(rows.sparkSession)
    fields = arrow_schema(rows.sparkSession, schema)

    def flat(entry) -> tuple:
        return tuple(entry) if isinstance(entry, (tuple, list)) else (entry,)

    def by_entry(sums: dict) -> Iterator[list]:
        entries = list(sums.items())
        for s in range(0, len(entries), 1 << 16):
            yield list(zip(*(flat(k) + flat(v) for k, v in entries[s : s + (1 << 16)])))

    def given(sums: dict) -> Iterator[pa.RecordBatch]:
        for found in (columns or by_entry)(sums):
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(found, fields)], schema=fields)
        sums.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                add(sums, *(c.to_pylist() for c in batch.slice(s, 512).columns))
                if size(sums) > limit:
                    yield from given(sums)
        yield from given(sums)

    return rows.mapInArrow(run, schema)
