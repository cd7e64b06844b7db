"""Secret scans: patterns per text, then corpus-wide ownership of every value found.

A task finds the base spans (assignments, access keys, hex runs) and opaque candidates: other
runs of key characters that no base span touches. Every value is hashed. The hashes are
aggregated over the whole corpus by distinct repository and owner: a value that `WIDE` owners or
more hold is a widely copied example, one that a single owner holds and that looks like a key is
live. The method adds the live opaque candidates to the spans; base spans always stay.

One value may be in a third of all texts. Values are counted per (hash, owner, repository) before
they move, and a text asks for its values under (hash, bucket), where a bucket is one of `BUCKETS`
by row: a value has as many keys as buckets hold it, so no key is heavy and nothing is broadcast.

Defined results: a null text is an empty one; every input row gives one row, repeated ones too;
a null owner is an owner of its own, the empty string; an empty table gives no rows. Other columns
are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelproof.llm.common import written

KINDS = ("assign", "access", "hex", "opaque")
BASE = KINDS[:3]
BUCKETS = 64
# Owners from which on a value counts as a widely copied example.
WIDE = 3
# The base patterns, each with the length that its value needs.
PATTERNS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),
}
OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST_DIFFERENT = 10
# Words by which a value says itself that it isn't live.
PLACEHOLDER = re.compile(r"example|sample|dummy|changeme|placeholder|your|xxxx|test|1234567|abcdef", re.IGNORECASE | re.ASCII)

SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
        T.StructField("value", T.StringType()), T.StructField("looks", T.BooleanType()),
    ]
)


def looks_live(value: str) -> bool:
    """A letter, a digit, enough different characters and no placeholder word."""
    return (
        len(set(value)) >= LEAST_DIFFERENT
        and any("0" <= c <= "9" for c in value)
        and any(c.isalpha() for c in value)
        and not PLACEHOLDER.search(value)
    )


def candidates(text: str) -> list[tuple[str, int, int, str, bool]]:
    """(kind, start, end, value, looks live) of base spans and opaque candidates, by start and kind."""
    found = []
    for kind, (pattern, group, least) in PATTERNS.items():
        for m in pattern.finditer(text):
            if len(m[group]) >= least:
                found.append((kind, m.start(), m.end(), m[group], looks_live(m[group])))
    found.sort(key=lambda s: (s[1], BASE.index(s[0])))
    taken, at, covered = [], 0, 0
    for m in OPAQUE.finditer(text):
        # `covered` is the furthest end of the base spans that begin before the candidate's end.
        while at < len(found) and found[at][1] < m.end():
            covered = max(covered, found[at][2])
            at += 1
        if covered <= m.start() and looks_live(m[0]):
            taken.append(("opaque", m.start(), m.end(), m[0], True))
    return sorted(found + taken, key=lambda s: (s[1], KINDS.index(s[0])))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("looks", pa.bool_())]))
    names = SPAN.fieldNames()
    for batch in batches:
        spans = [[dict(zip(names, s, strict=True)) for s in candidates(t or "")] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "owner", "repository")), pa.array(spans, kind)], names=["doc_id", "owner", "repository", "spans"])


def ownership(values: DataFrame) -> DataFrame:
    """Per hash: distinct owners and repositories, and the buckets that hold it as 64 bits."""
    held = F.bit_or(F.expr("shiftleft(1L, bucket)")).alias("held")
    pairs = values.groupBy("hash", "owner", "repository").agg(held)
    owners = pairs.groupBy("hash", "owner").agg(F.count("*").alias("n"), F.bit_or("held").alias("held"))
    return owners.groupBy("hash").agg(
        F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"), F.bit_or("held").alias("held")
    )


def scanned(docs: DataFrame, owner: str = "source", repository: str = "lang") -> DataFrame:
    """doc_id and `spans`: (kind, start, end, base, status, n_owners, n_repositories), by start and kind.

    `repository` names a column that tells an owner's repositories apart. status is `live`,
    `example` or `unclear`.
    """
    whole = docs.select(
        "doc_id", F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"), "text",
    )
    schema = T.StructType([*whole.drop("text").schema.fields, T.StructField("spans", T.ArrayType(SPAN))])
    # The number of a row is written with it, so it stays the same when a task is run again.
    rows = whole.mapInArrow(_scan, schema).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "secret-spans")

    asked = rows.filter(F.size("spans") > 0).select(
        "row", "doc_id", "owner", "repository", F.pmod("row", F.lit(BUCKETS)).cast("int").alias("bucket"),
        F.posexplode("spans").alias("at", "span"),
    ).withColumn("hash", F.unhex(F.sha2("span.value", 256)))
    known = ownership(asked.select("hash", "owner", "repository", "bucket"))
    buckets = F.filter(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.getbit("held", b) == 1)
    known = known.select("hash", "n_owners", "n_repositories", F.explode(buckets).alias("bucket"))

    looks, alone, kind = F.col("span.looks"), F.col("n_owners") == 1, F.col("span.kind")
    status = F.when(F.col("n_owners") >= WIDE, "example").when(alone & looks, "live").otherwise("unclear")
    told = asked.select("row", "doc_id", "at", "bucket", "hash", "span").join(known, ["hash", "bucket"]).select(
        "row", "doc_id",
        F.struct(
            "at", kind.alias("kind"), F.col("span.start").alias("start"), F.col("span.end").alias("end"),
            kind.isin(*BASE).alias("base"), status.alias("status"), "n_owners", "n_repositories",
        ).alias("span"),
    ).filter(F.col("span.base") | (F.col("span.status") == "live"))
    told = told.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list("span")).alias("spans"))
    told = told.select("row", "doc_id", F.transform("spans", lambda s: s.dropFields("at")).alias("spans"))
    # Texts without any span that stays: all whose number wasn't told.
    rest = rows.select("row", "doc_id").join(told.select("row"), "row", "left_anti")
    none = F.array().cast(told.schema["spans"].dataType)
    return told.drop("row").unionByName(rest.select("doc_id", none.alias("spans")))


def _either(letters: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in letters)


_WORDS = "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key")))
_ASSIGN = rf"""({_WORDS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_PLACEHOLDERS = "|".join(map(_either, PLACEHOLDER.pattern.split("|")))
_LOOKS = f"len(list_distinct(string_split(value, ''))) >= {LEAST_DIFFERENT} AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND NOT regexp_matches(value, '{_PLACEHOLDERS}')"

# The same spans in SQL, whose places come from the lengths of matches and of the text between them.
CHECK = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, coalesce(lang, '') AS repository
  FROM documents
), p(kind, rank) AS (
  VALUES ('assign', 1), ('access', 2), ('hex', 3), ('opaque', 4)
), c AS (
  SELECT k, rank, CASE rank
      WHEN 1 THEN regexp_extract_all(t, '{_ASSIGN}') WHEN 2 THEN regexp_extract_all(t, 'AKIA[A-Z0-9]+')
      WHEN 3 THEN regexp_extract_all(t, '[0-9a-f]+') ELSE regexp_extract_all(t, '[A-Za-z0-9+/_=-]+') END AS found,
    CASE rank
      WHEN 1 THEN regexp_split_to_array(t, '{_ASSIGN}') WHEN 2 THEN regexp_split_to_array(t, 'AKIA[A-Z0-9]+')
      WHEN 3 THEN regexp_split_to_array(t, '[0-9a-f]+') ELSE regexp_split_to_array(t, '[A-Za-z0-9+/_=-]+') END AS gaps
  FROM d, p
), u AS (
  SELECT k, rank, unnest(found) AS m, unnest(gaps[:len(found)]) AS gap, generate_subscripts(found, 1) AS i FROM c WHERE len(found) > 0
), s AS (
  SELECT k, rank, m, (sum(length(gap) + length(m)) OVER (PARTITION BY k, rank ORDER BY i))::BIGINT AS stop,
    CASE rank WHEN 1 THEN regexp_extract(m, '{_ASSIGN}', 2) ELSE m END AS value
  FROM u
), a AS (
  SELECT k, rank, stop - length(m) AS start, stop, value, ({_LOOKS}) AS looks
  FROM s WHERE length(value) >= CASE rank WHEN 1 THEN 6 WHEN 2 THEN 20 WHEN 3 THEN 24 ELSE 20 END
), b AS (
  SELECT * FROM a WHERE rank < 4
  UNION ALL
  SELECT * FROM a WHERE rank = 4 AND looks
    AND NOT EXISTS (SELECT 1 FROM a AS o WHERE o.rank < 4 AND o.k = a.k AND o.start < a.stop AND o.stop > a.start)
), o AS (
  SELECT value, count(DISTINCT owner) AS owners FROM b JOIN d USING (k) GROUP BY value
), r AS (
  SELECT k, rank, start, kind || ':' || start || ':' || stop AS span,
    CASE WHEN owners >= {WIDE} THEN 'example' WHEN owners = 1 AND looks THEN 'live' ELSE 'unclear' END AS status
  FROM b JOIN o USING (value) JOIN p USING (rank)
), g AS (
  SELECT k, count(*) FILTER (rank = 1) AS n_assign, count(*) FILTER (rank = 2) AS n_access, count(*) FILTER (rank = 3) AS n_hex,
    string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 4) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans,
    count(*) FILTER (status = 'live') AS n_live, count(*) FILTER (status = 'example') AS n_example
  FROM r WHERE rank < 4 OR status = 'live' GROUP BY k
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example
FROM d LEFT JOIN g USING (k)
"""
