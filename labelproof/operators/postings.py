"""A kept inverted table: the words of documents, split by word range, with deltas.

An index is a folder of generations. Each holds

- ``docs``: a document with its length and its words (word, field, frequency),
- ``postings``: one row per word, document and field, range partitioned by word and document,
  so a word stands in few parts and a very common one is spread over several,
- ``terms``: the words of each part with the documents that hold them, and negative counts for
  the documents that a delta replaced,
- ``gone``: the documents whose earlier generations no longer count.

A generation counts once its line in ``log`` is written, which is the last step; what a failed
run left behind is never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelproof.functions import text as T
from labelproof.operators.search import top_rows
from labelproof.operators.skew import reliable

# Characters of a word by which an asked beginning meets the vocabulary.
HEAD = 3

DOCS = "doc {0}, largo int, palabras array<struct<palabra: string, campo: int, tf: int, primero: boolean>>, gen int"
POSTINGS = "palabra string, doc {0}, campo int, tf int, largo int, gen int, parte int"
TERMS = "palabra string, parte int, n bigint, gen int"
GONE = "doc {0}, gen int"


def plain_words(text: Column) -> Column:
    """Folded runs of letters and digits."""
    plain = F.trim(F.regexp_replace(T.fold(text), r"[^\p{L}\p{N}]+", " "))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def _tagged(field: str, place: int) -> Column:
    words = plain_words(F.coalesce(F.col(field), F.lit("")))
    return F.transform(words, lambda w: F.struct(w.alias("palabra"), F.lit(place).alias("campo")))


def forward(docs: DataFrame, fields: list[str]) -> DataFrame:
    """``doc, largo, palabras`` of each document, without a shuffle.

    The words of all fields are sorted; equal neighbours are one entry, and its frequency is
    the distance to the next one. ``primero`` marks the first field that holds a word.
    """
    tagged = F.flatten(F.array(*[_tagged(f, i) for i, f in enumerate(fields)]))
    df = docs.select("doc", F.sort_array(tagged).alias("_all"))

    def differs(w: Column, i: Column) -> Column:
        before = F.get("_all", i - 1)
        return (i == 0) | (before["palabra"] != w["palabra"]) | (before["campo"] != w["campo"])

    numbered = F.transform("_all", lambda w, i: F.struct(w.alias("w"), i.alias("i"), differs(w, i).alias("nuevo")))
    df = df.withColumn("_starts", F.filter(numbered, lambda p: p["nuevo"]))
    entries = F.transform(
        "_starts",
        lambda p, k: F.struct(
            p["w"]["palabra"].alias("palabra"),
            p["w"]["campo"].alias("campo"),
            (F.coalesce(F.get("_starts", k + 1)["i"], F.size("_all")) - p["i"]).alias("tf"),
            F.coalesce(F.get("_starts", k - 1)["w"]["palabra"] != p["w"]["palabra"], F.lit(True)).alias("primero"),
        ),
    )
    return df.select("doc", F.size("_all").alias("largo"), entries.alias("palabras"))


class Index:
    """One inverted table in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, fields: list[str], key: str = "string"):
        self.spark, self.folder, self.fields, self.key = spark, folder.rstrip("/"), fields, key

    def generations(self) -> list[int]:
        """The generations whose writing ended; one line each."""
        try:
            log = self.spark.read.schema("gen int").parquet(f"{self.folder}/log")
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return []
            raise
        return sorted(r["gen"] for r in log.collect())

    def _read(self, part: str, schema: str, of: list[int] | None = None) -> DataFrame:
        of = self.generations() if of is None else of
        rows = self.spark.read.option("basePath", f"{self.folder}/{part}").schema(schema.format(self.key))
        return rows.parquet(*[f"{self.folder}/{part}/gen={g}" for g in of])

    def _write(self, rows: DataFrame, part: str, gen: int, by: list[str] = ()) -> None:
        rows.write.mode("overwrite").partitionBy(*by).parquet(f"{self.folder}/{part}/gen={gen}")

    def _add(self, docs: DataFrame, gone: DataFrame | None, gen: int) -> None:
        """Write one generation: documents, postings, terms, superseded documents, its line in the log."""
        self._write(forward(docs, self.fields), "docs", gen)
        mine = self._read("docs", DOCS, [gen])
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = mine.select("doc", "largo", F.inline("palabras")).repartitionByRange(parts, "palabra", "doc")
        rows = rows.withColumn("parte", F.spark_partition_id()).sortWithinPartitions("parte", "palabra", "doc")
        self._write(rows.select("palabra", "doc", "campo", "tf", "primero", "largo", "parte"), "postings", gen, ["parte"])
        held = self._read("postings", POSTINGS + ", primero boolean", [gen]).filter("primero")
        terms = held.groupBy("palabra", "parte").agg(F.count("*").alias("n"))
        if gone is not None:
            self._write(gone.select("doc").distinct(), "gone", gen)
            dropped = self._read("gone", GONE, [gen]).select("doc")
            before = [g for g in self.generations() if g < gen]
            lost = self.live(before).join(dropped, "doc", "left_semi").select(F.inline("palabras")).filter("primero")
            lost = lost.groupBy("palabra").agg((-F.count("*")).alias("n"))
            terms = terms.unionByName(lost.select("palabra", F.lit(-1).alias("parte"), "n"))
        else:
            self._write(mine.select("doc").filter("false"), "gone", gen)
        self._write(terms, "terms", gen)
        self.spark.range(1).select(F.lit(gen).alias("gen")).write.mode("append").parquet(f"{self.folder}/log")

    def build(self, docs: DataFrame) -> Index:
        """The first generation, of all documents: ``doc`` and the fields."""
        if self.generations():
            raise ValueError(f"{self.folder} holds an index already")
        self._add(docs, None, 0)
        return self

    def apply(self, changed: DataFrame, removed: DataFrame | None = None) -> Index:
        """One more generation: changed or new documents, and the ids of removed ones."""
        gone = changed.select("doc")
        if removed is not None:
            gone = gone.unionByName(removed.select("doc"))
        self._add(changed, gone, self.generations()[-1] + 1)
        return self

    def _current(self, rows: DataFrame, of: list[int]) -> DataFrame:
        """Rows whose document wasn't replaced or removed by a later generation."""
        if len(of) < 2:
            return rows
        last = self._read("gone", GONE, of).groupBy("doc").agg(F.max("gen").alias("_until"))
        return rows.join(last, "doc", "left").filter(F.col("_until").isNull() | (F.col("gen") >= F.col("_until"))).drop("_until")

    def live(self, of: list[int] | None = None) -> DataFrame:
        """The documents as they are now, with their words."""
        of = self.generations() if of is None else of
        return self._current(self._read("docs", DOCS, of), of)

    def vocabulary(self) -> DataFrame:
        """``palabra, n``: every word with the documents that hold it, in order."""
        sums = self._read("terms", TERMS).groupBy("palabra").agg(F.sum("n").alias("n"))
        return sums.filter("n > 0").orderBy("palabra")

    def wanted(self, asked: DataFrame) -> DataFrame:
        """``prefijo, palabra, gen, parte``: where the words lie that asked beginnings expand to."""
        terms = self._read("terms", TERMS).filter("parte >= 0")
        keyed = asked.select("prefijo", F.substring("prefijo", 1, HEAD).alias("_head"))
        sizes = sorted(r["n"] for r in keyed.select(F.length("_head").alias("n")).distinct().collect()) or [HEAD]
        heads = F.array_distinct(F.array(*[F.substring("palabra", 1, n) for n in sizes]))
        found = terms.withColumn("_head", F.explode(heads)).join(keyed, "_head")
        return found.filter(F.startswith("palabra", "prefijo")).select("prefijo", "palabra", "gen", "parte")

    def postings(self, wanted: DataFrame) -> DataFrame:
        """The postings of the wanted words; only the parts that hold one are read.

        The list of parts on the driver has one number per part at most.
        """
        of = self.generations()
        parts = wanted.select("gen", "parte").distinct().collect()
        lines = {g: sorted(r["parte"] for r in parts if r["gen"] == g) for g in of}
        held = F.lit(False)
        for gen, numbers in lines.items():
            if numbers:
                held = held | ((F.col("gen") == gen) & F.col("parte").isin(numbers))
        rows = self._read("postings", POSTINGS, of).filter(held)
        return rows.join(wanted, ["gen", "parte", "palabra"])

    def search(self, queries: DataFrame, top: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """Prefix full-text search: ``q_id, doc, puntaje, lugar`` of ``q_id, q_texto``.

        Every query word must start a word of the document, in any field; the score is BM25
        where the words that a prefix expands to, in all fields, count as one term.
        """
        of = self.generations()
        asked = queries.select("q_id", F.explode(F.array_distinct(plain_words(F.col("q_texto")))).alias("prefijo"))
        need = asked.groupBy("q_id").agg(F.count("*").alias("_need"))
        wanted = reliable(self.wanted(asked.select("prefijo").distinct()))
        hits = self.postings(wanted).groupBy("doc", "gen", "prefijo").agg(F.sum("tf").alias("_tf"), F.max("largo").alias("_len"))
        # Read for the frequencies and for the scores.
        hits = reliable(self._current(hits, of).select("doc", "prefijo", "_tf", "_len"))
        stats = self._current(self._read("docs", DOCS, of).select("doc", "gen", "largo"), of)
        stats = stats.agg(F.count("*").alias("_docs"), F.avg("largo").alias("_avg"))
        frequency = hits.groupBy("prefijo").agg(F.count("*").alias("_df"))
        idf = F.ln((F.col("_docs") - F.col("_df") + 0.5) / (F.col("_df") + 0.5) + 1.0)
        weight = F.col("_tf") * (k1 + 1) / (F.col("_tf") + k1 * (1 - b + b * F.col("_len") / F.col("_avg")))
        # Written, so that its real size decides on a broadcast. The hits are brought together by
        # document while a hit is one row, not one row for each query that asks it.
        terms = reliable(asked.join(frequency, "prefijo"))
        scored = (
            hits.repartition("doc")
            .join(terms, "prefijo")
            .withColumn("_docs", stats.select("_docs").scalar())
            .withColumn("_avg", stats.select("_avg").scalar())
            .select("q_id", "doc", (idf * weight).alias("_s"))
            .groupBy("q_id", "doc")
            .agg(F.sum("_s").alias("puntaje"), F.count("*").alias("_have"))
            .join(need, "q_id")
            .filter("_have = _need")
            .select("q_id", "doc", "puntaje")
        )
        # Sums of the same terms differ by the order of adding; they count as equal.
        return top_rows(scored, "q_id", [F.desc(F.round("puntaje", 6)), F.asc("doc")], top)
