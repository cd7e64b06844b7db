"""Language identification by compression.

For every language a raw-content zstandard dictionary is cut from a bounded training sample: the
`TEXTS` training rows with the lowest id hashes, `PREFIX` characters each, up to `DICTIONARY`
bytes. A text is reduced to its letters in lower case, cut into blocks of `BLOCK` bytes so that
the dictionary counts to the end of a long text, and compressed once per language; the smallest
sum wins. The margin to the second language, relative to its size, gives the score. Where the
margin is below `NARROW` the blocks are compressed again with the strongest matcher, and the
answer is marked as rejected if the margin stays below `REJECT`.

Defined results: null texts and texts without a letter are `und` with score 0 and rejected; rows
with a null language aren't learned from; with no learned language everything is `und`; ties go
to the first language in order; repeated rows get one result each; extra columns pass through,
except `lang_pred`, `score` and `rejected`, which are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelproof.llm.common import held_out

TEXTS, PREFIX, DICTIONARY = 128, 2000, 96 * 1024
BLOCK = 4096
LEVEL, STRONG = 6, 19
NARROW, REJECT = 0.03, 0.005
NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> bytes:
    """The text in lower case without signs and digits; empty if it has no letter.

    Number signs like Roman numerals and fractions are word characters, but no letters.
    """
    kept = NOT_LETTERS.sub(" ", text.lower()).strip() if text else ""
    return kept.encode() if any(map(str.isalpha, kept)) else b""


def dictionaries(docs: DataFrame, texts: int = TEXTS, prefix: int = PREFIX, size: int = DICTIONARY) -> dict[str, bytes]:
    """Language -> dictionary content, from training rows only."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.select("lang", F.xxhash64(F.col("doc_id").cast("string")).alias("order"), F.substring("text", 1, prefix).alias("text"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("order", "text"))
    out: dict[str, bytes] = {}
    for row in rows.withColumn("n", first).filter(F.col("n") <= texts).orderBy("lang", "n").collect():
        held = out.get(row["lang"], b"")
        if len(held) < size:
            out[row["lang"]] = (held + letters(row["text"]) + b" ")[:size]
    return out


class Judge:
    """One compressor per language and level."""

    def __init__(self, content: dict[str, bytes]):
        self.content, self.names = content, sorted(content)
        self.fast, self.strong = self._compressors(LEVEL), None

    def _compressors(self, level: int) -> list:
        import zstandard

        out = []
        for name in self.names:
            held = zstandard.ZstdCompressionDict(self.content[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=level)
            out.append(zstandard.ZstdCompressor(level=level, dict_data=held, write_checksum=False, write_content_size=False))
        return out

    def _best(self, blocks: list[bytes], compressors: list) -> tuple[str, float]:
        sizes = sorted((sum(len(c.compress(b)) for b in blocks), i) for i, c in enumerate(compressors))
        if len(sizes) == 1:
            return self.names[0], 1.0
        return self.names[sizes[0][1]], (sizes[1][0] - sizes[0][0]) / sizes[1][0]

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        data = letters(text)
        if not data or not self.names:
            return "und", 0.0, True
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        name, margin = self._best(blocks, self.fast)
        if margin < NARROW:
            self.strong = self.strong or self._compressors(STRONG)
            name, margin = self._best(blocks, self.strong)
        return name, 1 - math.exp(-margin / 0.03), margin < REJECT


def predicted(docs: DataFrame, content: dict[str, bytes], text: str = "text") -> DataFrame:
    """`docs` with `lang_pred`, `score` and `rejected`."""
    new = ("lang_pred", "score", "rejected")
    kept = [f for f in docs.schema if f.name not in new]
    schema = T.StructType([*kept, *(T.StructField(n, k, False) for n, k in zip(new, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(content)
        for batch in batches:
            found = [judge(t.as_py()) for t in batch.column(batch.schema.get_field_index(text))]
            columns = [pa.array([f[i] for f in found], k) for i, k in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *new])

    return docs.select(*(f.name for f in kept)).mapInArrow(run, schema)
