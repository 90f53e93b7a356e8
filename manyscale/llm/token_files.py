"""Token ids in Arrow stream files of fixed-size-list batches, and random access to them.

A table of documents becomes shards in ascending ``doc_id`` order. A shard is one Arrow stream file whose columns
are ``ids`` and ``mask``, both fixed-size lists of ``length`` entries, the smallest unsigned type that holds every
id, uncompressed: sequence ``i`` of a shard sits in batch ``i // BATCH`` at row ``i % BATCH``, and a memory-mapped
reader gets it without copying. Documents follow each other without gaps; each ends with the end id; only the last
sequence of a shard is filled up, where ``mask`` is false. Beside a shard lies a stream file with the span of
each document.

Defined results: a null or empty text is the end id alone; null ``doc_id`` come first; rows that repeat a
``doc_id`` follow each other by text; an empty table has no shard.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyscale.llm import common
from manyscale.plans import shipping

#: Sequences in a record batch.
BATCH = 64
#: Entries of a task's memory of pieces; it is emptied beyond that.
REMEMBERED = 1_000_000


class PieceIds(dict):
    """Ids of each piece of a text, as bytes. A piece starts at the text's start or at a single space before a letter.

    The library's pre-tokens never reach over such a place, so piece by piece gives the ids of the whole text. A piece
    with white space at an end gets None: a text with such a piece is encoded whole.
    """

    def __init__(self, content: str, kind: np.dtype):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.kind = Tokenizer.from_str(content), kind

    def learn(self, texts: list[str]) -> None:
        if len(self) > REMEMBERED:
            self.clear()
        wanted = set()
        for text in texts:
            first, *rest = text.split(" ")
            wanted.update(rest)
            wanted.add(" " + first)
        wanted = [p for p in wanted if p not in self]
        plain = []
        for piece in wanted:
            body = piece.removeprefix(" ")
            if not body or body[0].isspace() or body[-1].isspace():
                self[piece] = None
            else:
                plain.append(piece)
        for start in range(0, len(plain), 20_000):
            part = plain[start:start + 20_000]
            found = self.library.encode_batch_fast([p[1:] if p[0] == " " else " " + p for p in part], add_special_tokens=False)
            for piece, encoded in zip(part, found):
                self[piece] = np.array(encoded.ids, self.kind).tobytes()

    def of(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        try:
            return self[" " + first] + b"".join(map(self.__getitem__, rest))
        except TypeError:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()


@lru_cache(maxsize=2)
def piece_ids(content: str, kind: str) -> PieceIds:
    """Kept for all tasks of a Python worker."""
    return PieceIds(content, np.dtype(kind))


def id_type(content: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_str(content).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


class Shard:
    """Writes one shard; it takes its final name only when it is complete, so a lost task leaves nothing behind."""

    def __init__(self, folder: str, name: str, attempt: int, kind: str, length: int):
        self.files, root = pa.fs.FileSystem.from_uri(folder)
        self.files.create_dir(root, recursive=True)
        self.final = [f"{root}/{name}.arrow", f"{root}/{name}.spans.arrow"]
        self.open = [f"{path}.{attempt}" for path in self.final]
        self.kind, self.length, self.left, self.total = np.dtype(kind), length, b"", 0
        ids = pa.from_numpy_dtype(self.kind)
        self.schema = pa.schema([("ids", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [self.files.open_output_stream(path) for path in self.open]
        self.out = [pa.ipc.new_stream(sink, schema) for sink, schema in zip(self.sinks, (self.schema, self.index))]

    def add(self, doc_ids: list, encoded: list[bytes]) -> None:
        sizes = np.array([len(e) // self.kind.itemsize for e in encoded], np.int64)
        starts = self.total + np.cumsum(sizes) - sizes
        self.out[1].write_batch(pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(sizes)], schema=self.index))
        self.total += int(sizes.sum())
        self.left = b"".join([self.left, *encoded])
        self._write(len(self.left) // (BATCH * self.length * self.kind.itemsize) * BATCH * self.length)

    def _write(self, n: int) -> None:
        values = np.frombuffer(self.left, self.kind, n)
        self.left = self.left[n * self.kind.itemsize:]
        for start in range(0, n, BATCH * self.length):
            self._batch(values[start:start + BATCH * self.length])

    def _batch(self, values: np.ndarray) -> None:
        room = -len(values) % self.length
        mask = np.arange(len(values) + room) < len(values)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (np.append(values, np.zeros(room, self.kind)), mask)]
        self.out[0].write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> int:
        if self.left:
            self._batch(np.frombuffer(self.left, self.kind))
        for writer, sink, path, final in zip(self.out, self.sinks, self.open, self.final):
            writer.close()
            sink.close()
            self.files.move(path, final)
        return self.total


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, length: int = 2048, end_id: int = 0, id: str = "doc_id", text: str = "text") -> list[tuple[str, int]]:
    """Encode every whole text and write the shards; returns ``(shard name, ids in it)`` in order.

    One shuffle sorts the texts by id over ranges. The list has an entry for each partition, as many as the
    session's shuffle partitions at most, which is all that reaches the driver.
    """
    spark = docs.sparkSession
    shipping.ship(spark)
    kind = id_type(vocabulary)
    sent = spark.sparkContext.broadcast(vocabulary)
    ordered = (docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, shard = TaskContext.get(), None
        encoder = piece_ids(sent.value, kind)
        end = np.array([end_id], encoder.kind).tobytes()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            shard = shard or Shard(folder, f"shard-{context.partitionId():06d}", context.taskAttemptId(), kind, length)
            encoder.learn(texts)
            shard.add(batch.column(0).to_pylist(), [encoder.of(t) + end for t in texts])
        if shard:
            name = shard.final[0].rpartition("/")[2].removesuffix(".arrow")
            yield pa.RecordBatch.from_pydict({"shard": [name], "n": [shard.close()]})

    return sorted((r.shard, r.n) for r in ordered.mapInArrow(run, "shard string, n long").collect())


def open_stream(folder: str, name: str) -> list[pa.RecordBatch]:
    """The batches of a file; on a mapped file system they are views of the file."""
    files, root = pa.fs.FileSystem.from_uri(folder)
    path = f"{root}/{name}.arrow"
    source = pa.memory_map(path) if isinstance(files, pa.fs.LocalFileSystem) else files.open_input_file(path)
    return list(pa.ipc.open_stream(source))


def sequence(batches: list[pa.RecordBatch], i: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of sequence ``i`` of a shard; the ids are a view."""
    batch, row = batches[i // BATCH], i % BATCH
    ids, mask = batch.column(0), batch.column(1)
    length = ids.type.list_size
    return (ids.values.to_numpy(zero_copy_only=True)[row * length:(row + 1) * length],
            mask.values.slice(row * length, length).to_numpy(zero_copy_only=False))


def read_token_files(spark: SparkSession, folder: str, shards: list[tuple[str, int]]) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document, ``ids`` as little-endian unsigned 32-bit integers."""
    shipping.ship(spark)
    starts = np.cumsum([0] + [n for _, n in shards])
    rows = [(name, int(start)) for (name, _), start in zip(shards, starts)]
    listed = spark.createDataFrame(rows, "shard string, start long").repartition(max(1, len(rows)), "shard")
    schema = "doc_id long, start long, n_tokens long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                stream = open_stream(folder, name)
                width = BATCH * stream[0].column(0).type.list_size if stream else 1
                for spans in open_stream(folder, f"{name}.spans"):
                    firsts, sizes = spans.column(1).to_numpy(), spans.column(2).to_numpy()
                    ids = [span(stream, width, a, a + n).astype("<u4").tobytes() for a, n in zip(firsts.tolist(), sizes.tolist())]
                    for k in range(0, len(ids), 500):
                        part = slice(k, k + 500)
                        yield pa.RecordBatch.from_arrays([spans.column(0)[part], pa.array(firsts[part] + base), pa.array(sizes[part]),
                                                          pa.array(ids[part], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return listed.mapInArrow(run, schema)


def span(stream: list[pa.RecordBatch], width: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a shard."""
    parts = []
    for k in range(start // width, (stop - 1) // width + 1):
        values = stream[k].column(0).values.to_numpy(zero_copy_only=True)
        parts.append(values[max(0, start - k * width):stop - k * width])
    return parts[0] if len(parts) == 1 else np.concatenate(parts)
