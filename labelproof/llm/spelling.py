"""Spelling variants: words one edit apart, found by walking a trie level by level as joins.

A frontier holds states (word, position, node, edits); a node is named by its prefix. At each
level the frontier meets the edges of that depth: a state without an edit takes one, by another
letter (replaced) or by its own next letter (deleted), a state with its edit may only follow its
own letter. A state at the end of its word in a node that ends a word is a pair of neighbours.
The edit is always taken where the two words part, and an edge knows the letters that may follow
it, so most states that can't end well are never made.

Two words one edit apart agree in their first half or in their last half. So every word stands in
the trie twice, read forwards and read backwards, and takes its edit in its second half only: the
upper levels, where every word meets every letter, are never expanded. An edge table of one level
comes from the words by one aggregate; each state meets at most one edge per letter, whatever the
number of words below a node, and a node that many states are at is split by the adaptive join.

Levels are bounded by `LONGEST` letters. Longer words, of any length, meet on rolling hashes of
all their one-letter deletions instead, made in one pass over the word, and pairs are checked.

Defined results: a null text has no words; a null id is the empty string; an empty table gives no
rows; repeated rows count as often as they stand there; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelproof.llm.common import written

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# One in so many (document, word) pairs loses a letter.
NOISE = 199
SHORTEST, RAREST = 6, 5
# A form has so many times the occurrences of its variant.
RATIO = 5
LONGEST = 64
FORWARDS, BACKWARDS = ">", "<"


def words(docs: DataFrame) -> DataFrame:
    """word, n: runs of letters of whole texts, after the noise, with their occurrences."""
    run = F.explode(F.split(F.coalesce("text", F.lit("")), f"[^{LETTERS}]+"))
    # Only words that hold a capital of any kind pay for the letter by letter translation.
    low = F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", UPPER, LOWER))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    runs = runs.filter(F.length("run") >= SHORTEST).select("id", low.alias("low"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "low").cast("binary")))
    at = (F.col("h") % F.length("low")).cast("int")
    cut = F.concat(F.col("low").substr(F.lit(1), at), F.col("low").substr(at + 2, F.length("low")))
    word = F.when(F.col("h") % NOISE == 0, cut).otherwise(F.col("low"))
    counts = runs.select(word.alias("word")).filter(F.length("word") >= SHORTEST).groupBy("word")
    return counts.agg(F.count("*").alias("n")).filter(F.col("n") >= RAREST)


def _letter(text: Column, at: Column) -> Column:
    """The letter at a place counted from 0, empty behind the end."""
    return text.substr(at + 1, F.lit(1))


def _bit(letter: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(letter) % 64)


def edges(read: DataFrame, depth: int) -> DataFrame:
    """The trie's edges out of nodes of one depth: parent, letter, the word it ends with, letters that may follow."""
    s, size = F.col("s"), F.length("s")
    passing = read.filter(size > depth)
    following = F.when(size > depth + 1, _bit(_letter(s, F.lit(depth + 1)))).otherwise(F.lit(0).cast("long"))
    return passing.groupBy(s.substr(1, depth).alias("parent"), _letter(s, F.lit(depth)).alias("letter")).agg(
        F.bit_or(following).alias("follow"), F.max(F.when(size == depth + 1, F.col("n"))).alias("end_n")
    )


def step(read: DataFrame, frontier: DataFrame | None, depth: int) -> DataFrame:
    """States one level below: (s, n, pos, node, end_n), all with their edit taken."""
    s, pos, letter, size = F.col("s"), F.col("pos"), F.col("letter"), F.length("s")
    # The second half begins one place later, because of the mark of direction.
    fresh = read.filter((size >= depth) & (F.floor((size - 1) / 2) + 1 <= depth))
    states = fresh.select("s", "n", F.lit(depth).alias("pos"), s.substr(1, depth).alias("node"), F.lit(0).alias("edits"))
    if frontier is not None:
        states = states.unionByName(frontier.select("s", "n", "pos", "node", F.lit(1).alias("edits")))
    met = states.join(edges(read, depth), F.col("node") == F.col("parent"))
    own, after = _letter(s, pos), _letter(s, pos + 1)
    none = F.lit(None).cast("int")
    # The words differ in length by the last letter: the state is at its word's end.
    added = F.when((F.col("edits") == 0) & (pos == size) & F.col("end_n").isNotNull(), pos).otherwise(none)
    # Of two words that differ by a replaced letter, the one with the smaller letter finds the other.
    replaced = F.when((F.col("edits") == 0) & (pos < size) & (letter > own), pos + 1).otherwise(none)
    deleted = F.when((F.col("edits") == 0) & (pos + 1 < size) & (letter == after) & (after != own), pos + 2).otherwise(none)
    followed = F.when((F.col("edits") == 1) & (letter == own), pos + 1).otherwise(none)
    moves = F.array_compact(F.array(added, replaced, deleted, followed))
    moved = met.select("s", "n", F.concat("node", "letter").alias("node"), "end_n", "follow", F.explode(moves).alias("pos"))
    ends = (pos == size) & F.col("end_n").isNotNull()
    goes_on = (pos < size) & (F.col("follow").bitwiseAND(_bit(own)) != 0)
    return moved.filter(ends | goes_on).select("s", "n", pos.cast("int").alias("pos"), "node", "end_n")


def _plain(marked: str) -> Column:
    word = F.expr(f"substring({marked}, 2)")
    return F.when(F.col(marked).startswith(FORWARDS), word).otherwise(F.reverse(word))


def walked(vocabulary: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): pairs one edit apart among words of at most LONGEST letters, maybe twice."""
    short = vocabulary.filter(F.length("word") <= LONGEST)
    marked = F.array(F.concat(F.lit(FORWARDS), "word"), F.concat(F.lit(BACKWARDS), F.reverse("word")))
    read = written(short.select(F.explode(marked).alias("s"), "n"), "spelling-words")
    deepest = read.agg(F.max(F.length("s")).alias("d")).first()["d"] or 0
    found, frontier = [], None
    for depth in range(SHORTEST // 2 + 1, deepest):
        states = written(step(read, frontier, depth), "spelling-frontier")
        found.append(states.filter(F.col("pos") == F.length("s")))
        frontier = states.filter(F.col("pos") < F.length("s"))
    pairs = reduce(DataFrame.unionByName, found) if found else read.select("s", "n", F.lit("").alias("node"), F.col("n").alias("end_n")).filter("false")
    return pairs.select(_plain("s").alias("a"), F.col("n").alias("a_n"), _plain("node").alias("b"), F.col("end_n").alias("b_n"))


_PRIME, _FACTOR = (1 << 61) - 1, 1_000_003


def _deletions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, size, at, hash): every word's own hash at -1, those of its deletions at -2 and at the place."""
    names = ["id", "size", "at", "hash"]
    for batch in batches:
        for key, word in zip(batch.column("id").to_pylist(), batch.column("word").to_pylist(), strict=True):
            before, powers = [0], [1]
            for c in word:
                before.append((before[-1] * _FACTOR + ord(c)) % _PRIME)
                powers.append(powers[-1] * _FACTOR % _PRIME)
            size, behind, cut = len(word), 0, [0] * len(word)
            for i in range(size - 1, -1, -1):
                cut[i] = (before[i] * powers[size - 1 - i] + behind) % _PRIME
                behind = (behind + ord(word[i]) * powers[size - 1 - i]) % _PRIME
            shorter = sorted(set(cut))
            rows = 1 + size + len(shorter)
            columns = [
                pa.array([key] * rows, pa.int64()), pa.array([size] * (1 + size) + [size - 1] * len(shorter), pa.int32()),
                pa.array([-1, *range(size)] + [-2] * len(shorter), pa.int32()), pa.array([before[-1], *cut, *shorter], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def hashed(vocabulary: DataFrame) -> DataFrame:
    """The same pairs among words of LONGEST letters or more, by hashes of their deletions."""
    long = vocabulary.filter(F.length("word") >= LONGEST).withColumn("id", F.monotonically_increasing_id())
    long = written(long, "spelling-long")
    if long.isEmpty():
        return long.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    cut = written(long.select("id", "word").mapInArrow(_deletions, "id long, size int, at int, hash long"), "spelling-deletions")
    one, other = cut.alias("x"), cut.alias("y")
    same = (F.col("x.hash") == F.col("y.hash")) & (F.col("x.size") == F.col("y.size"))
    # A hash at one place stands for one word for each letter there, at most.
    places = F.col("x.at") == F.col("y.at")
    replaced = one.filter("x.at >= 0").join(other.filter("y.at >= 0"), same & places & (F.col("x.id") < F.col("y.id")))
    deleted = one.filter("x.at = -2").join(other.filter("y.at = -1"), same)
    pairs = replaced.select(F.col("x.id").alias("i"), F.col("y.id").alias("j")).union(deleted.select("x.id", "y.id")).distinct()
    first, second = long.toDF("a", "a_n", "i"), long.toDF("b", "b_n", "j")
    return pairs.join(first, "i").join(second, "j").filter(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n")


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """(word, near, near_n): both directions of all pairs of words one edit apart."""
    pairs = walked(vocabulary).unionByName(hashed(vocabulary))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).union(
        pairs.select("b", "a", "a_n")
    )
    return both.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, twice as far in each round.

    A form has at least RATIO times its word's occurrences, so a chain of 64-bit counts has less
    than 28 steps and five rounds reach its end.
    """
    chain = written(forms.select("word", F.col("form").alias("root")), "spelling-chain")
    for _ in range(5):
        further = chain.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        joined = chain.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        joined = written(joined, "spelling-chain")
        chain = joined.select("word", "root")
        if joined.filter("moved").isEmpty():
            break
    return chain


def grouped(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word."""
    vocabulary = written(words(docs), "spelling-vocabulary")
    near = neighbours(vocabulary).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")
    )
    rows = vocabulary.join(near, "word", "left")
    form_n = -F.col("best.less")
    rows = rows.withColumn("form_n", F.when(form_n >= RATIO * F.col("n"), form_n))
    rows = rows.select(
        "word", F.when(F.col("form_n").isNotNull(), F.col("best.form")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n",
    )
    rows = written(rows, "spelling-forms")
    last = roots(rows.filter(F.col("form").isNotNull()))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


# The same result in SQL: CRC-32 by its table, neighbours by their deletions.
CHECK = rf"""
WITH RECURSIVE c(i, k, v) AS (
  SELECT i, 0, i::BIGINT FROM range(256) AS r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM c WHERE k < 8
), crc AS (
  SELECT list(v ORDER BY i) AS t FROM c WHERE k = 8
), r AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(coalesce(text, ''), '[{LETTERS}]+')) AS run FROM documents
), l AS (
  SELECT id, translate(run, '{UPPER}', '{LOWER}') AS low, count(*) AS n FROM r WHERE length(run) >= {SHORTEST} GROUP BY ALL
), x AS (
  SELECT id, low, n, hex(encode(id || ':' || low)) AS x FROM l
), b AS (
  SELECT id, low, n, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::INT, 2))::BIGINT) AS bytes FROM x
), h AS (
  SELECT low, n, xor(list_reduce(bytes, lambda v, y: xor(t[(xor(v, y) & 255) + 1], v >> 8), 4294967295::BIGINT), 4294967295) AS h FROM b, crc
), w AS (
  SELECT CASE WHEN h % {NOISE} = 0 THEN substr(low, 1, (h % length(low))::INT) || substr(low, (h % length(low))::INT + 2) ELSE low END AS word, sum(n)::BIGINT AS n
  FROM h GROUP BY 1 HAVING length(word) >= {SHORTEST} AND sum(n) >= {RAREST}
), e AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, unnest(range(1, length(word) + 1))::INT AS i FROM w)
), p AS (
  SELECT x.word AS a, y.word AS b FROM e AS x JOIN e AS y USING (cut, i) WHERE x.word <> y.word
  UNION SELECT e.word, w.word FROM e JOIN w ON e.cut = w.word
  UNION SELECT w.word, e.word FROM e JOIN w ON e.cut = w.word
), f AS (
  SELECT a AS word, count(*)::BIGINT AS n_near, arg_max(b, (w.n, -rank)) AS best, max(w.n) AS best_n
  FROM p JOIN (SELECT word, n, row_number() OVER (ORDER BY encode(word)) AS rank FROM w) AS w ON w.word = b GROUP BY a
), g AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {RATIO} * n THEN best END AS form,
    CASE WHEN best_n >= {RATIO} * n THEN best_n END AS form_n
  FROM w LEFT JOIN f USING (word)
), chain(word, root, steps) AS (
  SELECT word, word, 0 FROM g
  UNION ALL
  SELECT chain.word, g.form, steps + 1 FROM chain JOIN g ON g.word = chain.root WHERE g.form IS NOT NULL
)
SELECT word, form, root, n, n_near, form_n
FROM g JOIN (SELECT word, arg_max(root, steps) AS root FROM chain GROUP BY word) USING (word)
"""
