"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last eight bytes cuts a text wherever its top bits are zero, so equal
passages are cut alike wherever they stand. A task encodes a chunk once while it remembers it
(exact bytes are the key, the memory is bounded), for all documents that share it. Tokens at a
chunk's ends may depend on what follows, so only its inside is kept: what lies between its first
and last white space, at which no token can begin or end elsewhere. A join is repaired by
encoding the last piece of one chunk with the first of the next; a chunk without white space
can't agree with its neighbours alone, so the piece grows over it until white space is met on
both sides. The result equals the encoding of the whole text, which the tests hold against the
library.

Defined results: null text counts as empty and gives no ids and an empty decoded text; repeated
rows are encoded each; an empty table gives no rows. Extra columns pass through, but those named
`ids` or `decoded` are replaced. Texts of any length are read whole; output goes out in batches
of bounded bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelproof.llm.tokens import UNSURE, Pieces, pieces

# A cut where 64-bit hash < 2**64 / MEAN_CHUNK: chunks of about this many bytes.
MEAN_CHUNK = 1024
MULTIPLIER = 0x9E3779B97F4A7C15
HELD_BYTES = 48_000_000
FLUSH_BYTES = 16_000_000
BLANK = re.compile(rb"[ \t\n\x0b\x0c\r]")


def cuts(data: bytes, mean: int = MEAN_CHUNK) -> list[int]:
    """Places at which the content cuts the bytes, always between two code points."""
    if len(data) < 9:
        return []
    seen = np.frombuffer(data, np.uint8)
    last8 = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(seen, 8)).view("<u8").ravel()
    at = np.flatnonzero(last8 * np.uint64(MULTIPLIER) < np.uint64(2**64 // mean)) + 8
    at = at[at < len(data)]
    return at[(seen[at] & 0xC0) != 0x80].tolist()


class Chunks:
    """Chunk bytes -> (before the first white space, ids of the inside, after the last one)."""

    def __init__(self, encoder: Pieces, held_bytes: int = HELD_BYTES):
        self.encoder, self.most = encoder, held_bytes
        self.held: dict[bytes, tuple] = {}
        self.size = self.reused = self.made = 0

    def __call__(self, chunk: bytes) -> tuple:
        known = self.held.get(chunk)
        if known is not None:
            self.reused += 1
            return known
        first = BLANK.search(chunk)
        if first is None:
            return chunk, None, b""
        last = max(chunk.rfind(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
        inside = self.encoder.encode(chunk[first.start() : last].decode())
        known = chunk[: first.start()], inside, chunk[last + 1 :]
        self.made += 1
        self.size += len(chunk) + len(inside) + 300
        if self.size > self.most:
            self.held, self.size = {}, 0
        self.held[chunk] = known
        return known

    def encode(self, text: str, mean: int = MEAN_CHUNK) -> bytes:
        """Packed ids of the whole text."""
        encoder = self.encoder
        if not encoder.known or any(c in text for c in UNSURE):
            return encoder.whole(text)
        data = text.encode()
        out, seam, start = [], b"", 0
        for end in [*cuts(data, mean), len(data)]:
            head, inside, tail = self(data[start:end])
            start = end
            seam += head
            if inside is not None:
                out.append(encoder.encode(seam.decode()))
                out.append(inside)
                seam = tail
        out.append(encoder.encode(seam.decode()))
        return b"".join(out)


def encode_decode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """`docs` with `ids` (array of int) and `decoded`, as the tokenizers library gives them."""
    kept = [f for f in docs.schema if f.name not in ("ids", "decoded")]
    frame = docs.select(*(f.name for f in kept))
    schema = T.StructType(
        [*kept, T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), T.StructField("decoded", T.StringType(), False)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces(path)
        chunks = Chunks(encoder)
        for batch in batches:
            texts, from_row = batch.column(batch.schema.get_field_index(text)), 0
            packed, decoded, size = [], [], 0
            for row in range(batch.num_rows):
                ids = chunks.encode(texts[row].as_py() or "")
                packed.append(ids)
                decoded.append(encoder.decode(np.frombuffer(ids, "<u4").tolist()))
                size += len(ids) + len(decoded[-1])
                if size >= FLUSH_BYTES or row + 1 == batch.num_rows:
                    yield _joined(batch.slice(from_row, row + 1 - from_row), packed, decoded)
                    packed, decoded, size, from_row = [], [], 0, row + 1

    return frame.mapInArrow(run, schema)


def _joined(batch: pa.RecordBatch, packed: list[bytes], decoded: list[str]) -> pa.RecordBatch:
    ends = np.zeros(len(packed) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in packed], out=ends[1:])
    values = pa.array(np.frombuffer(b"".join(packed), "<i4"))
    ids = pa.ListArray.from_arrays(pa.array(ends), values)
    return pa.RecordBatch.from_arrays(
        [*batch.columns, ids, pa.array(decoded, pa.string())], [*batch.schema.names, "ids", "decoded"]
    )


def digest(ids: Column) -> Column:
    """Lowercase hex sha256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)
