"""Token ids as Arrow files of fixed-size-list batches.

A shard is one Arrow file. Its batches hold `ROWS` sequences of `LENGTH` ids each as
fixed-size lists: `ids` (16 or 32 bits wide), `mask` (true for an id, false for padding at
the end of the shard) and `ends` (true for a document's last id). All sequences of a file have
the same length, so sequence n is row n % ROWS of batch n // ROWS, reached through the file's
footer without decoding anything before it. `shard-N.docs.arrow` beside it lists the
documents of the shard in order.

Rows are split by ranges of doc_id (ties by a hash of the text), so the shards in order hold all documents
in ascending order, and a hot id's rows may share a shard but no group is gathered. Text is
encoded after that shuffle, row by row. A task writes its files under names of its own and
reports them; only reported files belong to the set, so a lost executor's leftovers are never
read. The driver keeps one line per shard. A shard's start is the sum of the ids before it.

Defined results: null text counts as empty and yields the end id alone; null ids come first;
repeated rows are written each; an empty table gives no shard and no rows; other columns aren't
written. A text longer than a batch runs on over many.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelproof.llm.tokens import pieces

LENGTH = 1024
ROWS = 256
SHARD = "shard long, path string, tokens long, documents long"
DOCUMENT = "doc_id long, start long, n_tokens long, ids_crc32 long"


@contextmanager
def _open(path: str, mode: str):
    """A file of the shared folder, local or of any store that pyarrow reaches."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    if mode == "w":
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        with system.open_output_stream(inner) as out:
            yield out
    elif isinstance(system, fs.LocalFileSystem):
        with pa.memory_map(inner) as source:
            yield source
    else:
        with system.open_input_file(inner) as source:
            yield source


def sequence_schema(wide: bool, length: int = LENGTH) -> pa.Schema:
    kind = pa.uint32() if wide else pa.uint16()
    return pa.schema(
        [("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length)), ("ends", pa.list_(pa.bool_(), length))]
    )


class ShardWriter:
    """Cuts a run of documents into sequences and writes whole batches as they fill."""

    def __init__(self, out, schema: pa.Schema, length: int = LENGTH, rows: int = ROWS):
        self.schema, self.length, self.rows = schema, length, rows
        self.kind = np.uint32 if schema.field("ids").type.value_type == pa.uint32() else np.uint16
        self.writer = pa.ipc.new_file(out, schema)
        self.size = length * rows
        self.ids, self.ends = np.zeros(self.size, self.kind), np.zeros(self.size, bool)
        self.at = self.tokens = 0

    def add(self, ids: np.ndarray) -> None:
        self.tokens += len(ids)
        done = 0
        while done < len(ids):
            n = min(len(ids) - done, self.size - self.at)
            self.ids[self.at : self.at + n] = ids[done : done + n]
            self.at, done = self.at + n, done + n
            if done == len(ids):
                self.ends[self.at - 1] = True
            if self.at == self.size:
                self._write()

    def _write(self) -> None:
        used = -(-self.at // self.length) * self.length
        lists = lambda v: pa.FixedSizeListArray.from_arrays(pa.array(v), self.length)
        columns = [lists(self.ids[:used]), lists(np.arange(used) < self.at), lists(self.ends[:used])]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.ids, self.ends, self.at = np.zeros(self.size, self.kind), np.zeros(self.size, bool), 0

    def close(self) -> None:
        if self.at:
            self._write()
        self.writer.close()


def write(docs: DataFrame, folder: str, path: str, end_id: int = 1, length: int = LENGTH, rows: int = ROWS) -> list[dict]:
    """Write the table's token files under `folder`; one entry per shard, in order, with its start.

    `docs` needs doc_id and text. `path` is the vocabulary file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encoder, ids_of = None, []
        name = f"{folder}/shard-{shard:05d}-{uuid.uuid4().hex}"
        end = np.array([end_id], np.uint32)
        with _open(f"{name}.arrow", "w") as out:
            for batch in batches:
                for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                    if encoder is None:
                        encoder = pieces(path)
                        writer = ShardWriter(out, sequence_schema(len(encoder.names) > 65_536, length), length, rows)
                    writer.add(np.concatenate([np.frombuffer(encoder.encode(text.as_py() or ""), "<u4"), end]))
                    ids_of.append(doc_id.as_py())
            if encoder is not None:
                writer.close()
        if encoder is None:
            return
        with _open(f"{name}.docs.arrow", "w") as out, pa.ipc.new_file(out, pa.schema([("doc_id", pa.int64())])) as index:
            index.write_batch(pa.RecordBatch.from_arrays([pa.array(ids_of, pa.int64())], ["doc_id"]))
        yield pa.RecordBatch.from_pydict(
            {"shard": [shard], "path": [name], "tokens": [writer.tokens], "documents": [len(ids_of)]}
        )

    # The range bounds are sampled on the driver, so their key is short: the text's hash orders ties.
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    ordered = ordered.select("doc_id", "text")
    found = sorted((r.asDict() for r in ordered.mapInArrow(run, SHARD).collect()), key=lambda r: r["shard"])
    start = 0
    for entry in found:
        entry["start"] = start
        start += entry["tokens"]
    return found


def sequence(path: str, n: int, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Sequence n of a shard: ids and mask, without reading another."""
    with _open(f"{path}.arrow", "r") as source:
        batch = pa.ipc.open_file(source).get_batch(n // rows)
        ids, mask = batch.column(0)[n % rows].values, batch.column(1)[n % rows].values
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)


def documents(path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of a shard in order; holds one batch and one document."""
    with _open(f"{path}.docs.arrow", "r") as listed:
        names = iter(pa.ipc.open_file(listed).read_all().column(0).to_pylist())
    with _open(f"{path}.arrow", "r") as source:
        file, kept = pa.ipc.open_file(source), []
        for k in range(file.num_record_batches):
            batch = file.get_batch(k)
            ids = batch.column(0).flatten().to_numpy()
            mask = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            start = 0
            for end in np.flatnonzero(batch.column(2).flatten().to_numpy(zero_copy_only=False)) + 1:
                yield next(names), np.concatenate([*kept, ids[start:end]])
                kept, start = [], end
            rest = ids[start:][mask[start:]]
            if len(rest):
                kept.append(rest.copy())


def read(spark: SparkSession, shards: list[dict]) -> DataFrame:
    """The documents of the token files: doc_id, start, n_tokens and ids_crc32, one task per shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for doc_id, ids in documents(path):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                columns = zip(*rows, strict=True) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    listed = spark.createDataFrame([(s["path"], s["start"]) for s in shards], "path string, start long")
    return listed.repartition(max(1, len(shards))).mapInArrow(run, DOCUMENT)
