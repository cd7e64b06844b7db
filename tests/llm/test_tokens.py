"""BPE with chunk reuse and the token files, against the library."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelproof.llm import bpe, token_files
from labelproof.llm.common import new_folder
from labelproof.llm.tokens import Pieces, Recent, vocabulary

PATH = vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoder():
    return Pieces(PATH)


def unpacked(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()


def library(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


def odd_texts(n):
    random.seed(5)
    letters = "aZ\u00e9's\u00dft \n\t\x1c\u0301\u0130\u03a3\u03c20\u00bd.,-_\u00ff\u0178\xa0|<>ab  "
    for _ in range(n):
        text = "".join(random.choice(letters) for _ in range(random.randint(0, 40)))
        yield text + random.choice(["", "<|endoftext|>", "<|startoftext|>x"])


def test_pieces_equal_the_library(encoder):
    for text in odd_texts(3000):
        assert unpacked(encoder.encode(text)) == library(encoder, text), repr(text)


def test_chunks_equal_the_library_for_any_chunk_size(encoder):
    for mean in (2, 7, 64):
        chunks = bpe.Chunks(encoder, held_bytes=2000)
        for text in odd_texts(800):
            assert unpacked(chunks.encode(text, mean)) == library(encoder, text), repr(text)


def test_shared_passages_are_encoded_once(encoder):
    random.seed(1)
    passage = " ".join(str(random.random()) for _ in range(3000))
    chunks = bpe.Chunks(encoder)
    chunks.encode("one start " + passage)
    made = chunks.made
    chunks.encode("quite another beginning, " + passage)
    assert made > 20 and chunks.made - made <= 2 and chunks.reused >= made - 2


def test_cuts_keep_code_points_whole():
    data = "éèà 中文 ".encode() * 400
    for at in bpe.cuts(data, 4):
        data[:at].decode()


def test_recent_is_bounded():
    made = []
    memory = Recent(lambda k: made.append(k) or k.encode(), 10)
    for i in range(100):
        memory["hot"], memory[str(i)]
    assert len(memory) + len(memory.older) <= 10 and made.count("hot") == 1


def test_rows_equal_the_library(spark, odd, docs, none, encoder):
    both = odd.unionByName(docs).withColumn("ids", F.lit("clash"))
    rows = bpe.encode_decode(both, PATH).withColumn("digest", bpe.digest(F.col("ids"))).collect()
    assert len(rows) == both.count()
    for row in rows:
        ids = library(encoder, row["text"])
        assert row["ids"] == ids and row["decoded"] == encoder.tokenizer.decode(ids, skip_special_tokens=False)
        assert row["digest"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert bpe.encode_decode(none, PATH).count() == 0


def test_token_files(spark, odd, docs, none, encoder):
    both = odd.filter("doc_id IS NOT NULL").unionByName(docs.withColumn("doc_id", F.col("doc_id") + 100))
    shards = token_files.write(both, new_folder(spark, "files"), PATH, length=16, rows=4)
    got = sorted(map(tuple, token_files.read(spark, shards).collect()), key=lambda r: r[1])
    want, start = [], 0
    for row in sorted(both.collect(), key=lambda r: (r["doc_id"], r["text"] or "")):
        ids = [*library(encoder, row["text"]), 1]
        want.append((row["doc_id"], start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert got == want
    assert token_files.write(none, new_folder(spark, "files"), PATH) == [] and token_files.read(spark, []).count() == 0


def test_sequences_are_reached_without_reading_others(spark, docs, encoder):
    shards = token_files.write(docs, new_folder(spark, "files"), PATH, length=16, rows=4)
    path = shards[0]["path"]
    stream = np.concatenate([ids for _, ids in token_files.documents(path)])
    ids, mask = token_files.sequence(path, 5, rows=4)
    assert len(ids) == 16 and mask.all() and ids.tolist() == stream[80:96].tolist()
    ids, mask = token_files.sequence(path, (len(stream) - 1) // 16, rows=4)
    assert mask.sum() == (len(stream) - 1) % 16 + 1
    with token_files._open(f"{path}.arrow", "r") as source:
        schema = pa.ipc.open_file(source).schema
    assert schema.field("ids").type == pa.list_(pa.uint16(), 16) and schema.field("mask").type == pa.list_(pa.bool_(), 16)
