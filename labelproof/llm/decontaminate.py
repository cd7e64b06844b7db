"""Benchmark decontamination by template canonicalisation.

A text becomes a list of tokens in which numbers, units behind a number and names inside a
sentence are typed placeholders and all else is lower case. Windows of `WINDOW` tokens are hashed
and joined with those of the benchmark items, so a question met again with other numbers or
names still meets its template; windows of the plain lower-case words are joined as well, so a
copy in other case meets itself. A line end may or may not end a sentence: both templates are
joined. Windows made of placeholders for more than half count in their plain form only.
Hits of `SEED` tokens are joined into runs. An item is met when an occurrence covers as many of its
tokens as a run of `SHARE` percent of its windows of `WINDOW` has, or `RUN_TOKENS` in one run, or
when `SHARE` percent of these windows, or as many as a run of 50 words has, are found anywhere in
one document; `windows` and `matched` count windows of `WINDOW`. Where windows hold slots, one value of the item must stand for one value
of the document throughout one occurrence (a re-parameterised question substitutes consistently);
where it doesn't, only the windows without slots count. An occurrence is what lies at one distance
between document place and item place, give or take four; one that is consistent and enough is
sufficient, whatever other variants the document holds.

Only built-in functions are used. Document windows stream past the item windows, which are
broadcast only if their counted number is within `BROADCAST_ROWS`; otherwise both sides are
shuffled, and adaptive execution splits a hot window. They first meet the rarest windows of each
item only, as many as a met item can't do without; the pairs found that way then get all their
hits, by document and window.

Defined results: null or empty texts and items match nothing; an item shorter than a window is
matched by windows of its own length; rows that repeat an id count as one document or item; an
empty table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelproof.llm.common import written

WINDOW = 8
SHARE = 50
RUN = 50 - WINDOW + 1
BROADCAST_ROWS = 500_000
# Hits are windows of `SEED` tokens, of which `SEED_HELD` may be placeholders; any window of `WINDOW`
# that may be met is made of such. `RUN_TOKENS` met one after another are enough in any item.
SEED = 5
SEED_HELD = 4
RUN_TOKENS = 21
# Sentence ends are tokens while names are told from sentence starts.
TOKEN = r"[\p{L}\p{N}]+|[.!?\n]"
ENDS = (".", "!", "?", "\n")
NUMBER, CAPITAL, WORD, END, LINE = range(5)
PLACEHOLDERS = ("#num", "#name", "#unit")
UNITS = (
    "mm cm m km mg g kg t ml l s ms min h hr hz khz mhz ghz kb mb gb tb v w kw mw inch inches foot feet ft yard yards "
    "mile miles ounce ounces oz pound pounds lb lbs second seconds minute minutes hour hours day days week weeks month "
    "months year years dollar dollars usd euro euros eur cent cents percent degree degrees meter meters metre metres "
    "kilometer kilometers kilometre kilometres gram grams kilogram kilograms liter liters litre litres"
).split()


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def _told(table: DataFrame, text: str, *keep: str) -> DataFrame:
    """keep, the tokens in lower case, the kind of each, and whether there are line ends."""
    named = table.select(*keep, raw_tokens(F.col(text)).alias("raw"))
    named = named.withColumn("low", F.transform("raw", lambda t: F.lower(t)))

    def kind(t: Column, i: Column) -> Column:
        # The most common tokens are told by their first letter. Of all tokens only sentence ends and
        # those that begin with a digit lie before "@".
        return (
            F.when((t >= "a") & (t < "{"), WORD)
            .when(t < "@", F.when(t == "\n", LINE).when((t >= "0") & (t < ":"), NUMBER).otherwise(END))
            .when(t.rlike(r"^\p{Lu}\p{Ll}+$") & (t != F.get("low", i)), CAPITAL)
            .otherwise(WORD)
        )

    return named.select(*keep, "low", F.transform("raw", kind).alias("kinds"), F.array_contains("raw", "\n").alias("lines"))


def canonical(values: str, marks: Sequence, blank, wrapped: bool = False) -> Column:
    """The template of a text whose tokens are told: sentence ends go, placeholders come.

    `values` names what stands for each token, `marks` what stands for a number, a name and a unit.
    `wrapped` looks through one line end, which then ends no sentence; an empty line still does.
    """
    number, name, unit = map(F.lit, marks)

    def one(kind: Column, i: Column) -> Column:
        before = F.get("kinds", i - 1)
        if wrapped:
            before = F.when(before == LINE, F.get("kinds", i - 2)).otherwise(before)
        return (
            F.when((kind == WORD) & (before != NUMBER), F.get(values, i))
            .when(kind >= END, F.lit(blank))
            .when(kind == NUMBER, number)
            .when((kind == CAPITAL) & (before < END), name)
            .when((kind == WORD) & (before == NUMBER) & F.get("low", i).isin(*UNITS), unit)
            .otherwise(F.get(values, i))
        )

    return F.array_remove(F.transform("kinds", one), blank)


def templates(table: DataFrame, key: str, text: str, *keep: str) -> DataFrame:
    """key, and the three forms of the text, place by place: template, its form where lines
    are only wrapped, and plain lower case."""
    told = _told(table.withColumn(key, F.col(key).cast("long")), text, key, *keep)
    wrapped = F.when(F.col("lines"), canonical("low", PLACEHOLDERS, "", True)).otherwise(F.array().cast("array<string>"))
    # By the tokens themselves: a step read only inside this lambda would be repeated for each of them.
    lower = F.filter("low", lambda t: (t >= "0") & (t != "?"))
    return told.select(key, *keep, "lines", canonical("low", PLACEHOLDERS, "").alias("tokens"), wrapped.alias("wrapped"), lower.alias("lower"))


def coded(table: DataFrame, key: str, text: str, *keep: str) -> DataFrame:
    """The same three forms with the hash of every token, which is made once."""
    told = _told(table.withColumn(key, F.col(key).cast("long")), text, key, *keep)
    code = lambda t: F.when((t < "@") & ~((t >= "0") & (t < ":")), F.lit(0).cast("long")).otherwise(F.xxhash64(t))
    told = told.withColumn("codes", F.transform("low", code))
    marks = [F.xxhash64(F.lit(m)) for m in PLACEHOLDERS]
    wrapped = F.when(F.col("lines"), canonical("codes", marks, 0, True)).otherwise(F.array().cast("array<bigint>"))
    lower = F.array_remove("codes", 0)
    return told.select(key, *keep, "lines", canonical("codes", marks, 0).alias("tokens"), wrapped.alias("wrapped"), lower.alias("lower"))


def _hashed(table: DataFrame, span: int, *keep: str) -> DataFrame:
    """keep, place and hash: a row for each different form of a window; one mostly of placeholders is plain only.

    `span` is `WINDOW`, or the length of shorter items, which are met whole. `table` is `coded`; a
    window is the hash of its tokens' hashes.
    """
    size, most = (SEED, SEED_HELD) if span == WINDOW else (span, span // 2)
    rows = table.select(*keep, "lines", "lower", "tokens", "wrapped")
    count = F.least(F.size("tokens"), F.size("lower")) - (size - 1)
    # Not a filter: that would be moved below the steps it reads, and repeat them for every token.
    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.select("*", F.explode(places).alias("at"))
    marks = [F.xxhash64(F.lit(m)) for m in PLACEHOLDERS]

    def window(form: str) -> Column:
        return F.xxhash64(*(F.get(form, F.col("at") + k) for k in range(size)))

    def held(form: str) -> Column:
        flags = [F.coalesce(F.get(form, F.col("at") + k).isin(*marks), F.lit(False)).cast("int") for k in range(size)]
        return reduce(Column.__add__, flags)

    rows = rows.select(
        *keep, "at", window("lower").alias("a"), window("tokens").alias("b"), held("tokens").alias("b_held"),
        F.when(F.col("lines"), window("wrapped")).alias("c"), F.when(F.col("lines"), held("wrapped")).alias("c_held"),
    )
    few = lambda n: (F.col(n) > 0) & (F.col(n) <= most)
    forms = F.array(F.col("a"), F.when(few("b_held"), F.col("b")), F.when(few("c_held") & (F.col("c") != F.col("b")), F.col("c")))
    rows = rows.select(*keep, "at", "a", F.explode(forms).alias("hash")).filter(F.col("hash").isNotNull())
    return rows.select(*keep, "at", "hash", (F.col("hash") == F.col("a")).alias("literal"))


def _items(benchmark: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """One row per item with a token (row hash, words, slots, windows); and its window hashes by place."""
    named = benchmark.withColumn("item_row", F.xxhash64(F.col("item_id").cast("long"), text)).dropDuplicates(["item_row"])
    named = named.select("item_id", "item_row", F.col(text).alias("text"))
    rows = written(templates(named, "item_id", "text", "item_row").filter(F.size("tokens") > 0), "items")
    rows = rows.withColumn("span", F.least(F.size("tokens"), F.lit(WINDOW)))
    spans = sorted(r["span"] for r in rows.select("span").distinct().collect()) or [WINDOW]  # at most `WINDOW` values
    codes = coded(named, "item_id", "text", "item_row").join(rows.select("item_row", "span"), "item_row")
    parts = [_hashed(codes.filter(F.col("span") == n).drop("span"), n, "item_id", "item_row").withColumn("span", F.lit(n)) for n in spans]
    keys = parts[0]
    for part in parts[1:]:
        keys = keys.union(part)
    keys = written(keys.withColumnRenamed("at", "place"), "item-keys")
    held = lambda c: F.transform(c, lambda t: t.startswith("#"))
    rows = rows.select(
        "item_row", F.col("lower").alias("item_words"), "span", (F.size("tokens") - F.col("span") + 1).alias("windows"),
        held("tokens").alias("slots"), held("wrapped").alias("wrapped_slots"),
    )
    return written(rows, "item-windows"), keys


def _searched(items: DataFrame, keys: DataFrame, share: int) -> DataFrame:
    """The item windows to look for first: (hash, item_row, span), all but the most common ones of an item.

    An item that is met covers at least `least` windows, so of any set that leaves out fewer than
    that one is met. Left out are those that most items share, like the openings of questions: in
    them every document that holds one would meet every such item.
    """
    common = keys.groupBy("hash").agg(F.count_distinct("item_row").alias("among"))
    placed = keys.join(common, "hash").groupBy("item_row", "place").agg(F.max("among").alias("among"))
    rank = F.row_number().over(Window.partitionBy("item_row").orderBy(F.desc("among"), "place"))
    need = F.ceil(F.col("windows") * share / 100) + F.col("span") - 1
    least = F.when(F.col("span") == WINDOW, F.ceil(F.least(need, F.lit(RUN_TOKENS)) / SEED)).otherwise(1)
    kept = placed.withColumn("rank", rank).join(items.select("item_row", "windows", "span"), "item_row")
    kept = kept.filter((F.col("among") == 1) | (F.col("rank") >= least)).select("item_row", "place")
    return written(keys.join(kept, ["item_row", "place"], "left_semi").select("hash", "item_row", "span").distinct(), "searched")


def _runs(met: DataFrame, kind: str) -> DataFrame:
    """Hits whose places follow one another at one distance between document and item, joined."""
    along = Window.partitionBy("row", "item_row", "offset").orderBy("place")
    lane = ["doc_id", "row", "item_id", "item_row", "offset"]
    rows = met.withColumn("island", F.col("place") - F.row_number().over(along)).groupBy(*lane, "island")
    rows = rows.agg(F.min("place").alias("first"), F.max("end").alias("last"))
    return rows.drop("island").withColumn("kind", F.lit(kind))


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", share: int = SHARE) -> DataFrame:
    """doc_id, item_id, windows of the item, how many are met, distinct slot values, and consistent."""
    items, keys = _items(benchmark, text)
    known = sorted(r["span"] for r in items.select("span").distinct().collect())
    few = keys.count() <= BROADCAST_ROWS
    searched = _searched(items, keys, share)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    named = named.withColumn("row", F.xxhash64("doc_id", "text"))
    shaped, pairs = coded(named, "doc_id", "text", "row"), None
    for n in known or [WINDOW]:
        own = searched.filter(F.col("span") == n).select("hash", "item_row")
        part = _hashed(shaped, n, "doc_id", "row").join(F.broadcast(own) if few else own, "hash").select("doc_id", "row", "item_row")
        pairs = part if pairs is None else pairs.union(part)
    pairs = written(pairs.distinct(), "pairs")

    # All hits of these pairs: what a document asks for is its own, so no window is common to many.
    again = named.join(pairs.select("row").distinct(), "row", "left_semi").dropDuplicates(["row"])
    shaped, hits = coded(again, "doc_id", "text", "row"), None
    asked = pairs.join(F.broadcast(keys) if few else keys, "item_row")
    for n in known or [WINDOW]:
        own = asked.filter(F.col("span") == n).withColumn("end", F.col("place") + ((SEED if n == WINDOW else n) - 1))
        part = _hashed(shaped, n, "row").drop("literal").join(own, ["row", "hash"])
        hits = part if hits is None else hits.unionByName(part)
    met = hits.groupBy("doc_id", "row", "item_id", "item_row", "end", (F.col("at") - F.col("place")).alias("offset"), "place")
    met = written(met.agg(F.max("literal").alias("literal")), "met")
    runs = _runs(met, "any").union(_runs(met.filter("literal"), "plain"))
    enough = lambda c: (F.col(c) * 100 >= F.col("windows") * share) | (F.col(c) >= RUN)
    # As many tokens as one run of `share` percent of the windows covers, wherever they lie in the item.
    need = F.ceil(F.col("windows") * share / 100) + F.col("span") - 1

    # The tokens of the runs, in documents whose runs could be enough together; only their texts are read again.
    runs = written(runs.join(items.select("item_row", "windows", "span"), "item_row"), "runs")
    could = runs.filter("kind = 'any'").groupBy("doc_id", "item_row", "windows", "span")
    could = could.agg(F.sum(F.col("last") - F.col("first") + 1).alias("covered")).filter(F.col("covered") >= F.least(need, F.lit(RUN_TOKENS)))
    could = could.select(F.col("doc_id").alias("could_doc"), F.col("item_row").alias("could_row"))
    both = runs["doc_id"].eqNullSafe(could["could_doc"]) & (runs["item_row"] == could["could_row"])
    runs = written(runs.drop("windows", "span").join(could, both, "left_semi"), "could")
    again = named.join(runs.select("row").distinct(), "row", "left_semi").dropDuplicates(["row"])
    again = templates(again, "doc_id", "text", "row").select("row", F.col("lower").alias("words"))

    def token(j: Column) -> Column:
        item, doc = F.get("item_words", j), F.get("words", j + F.col("offset"))
        slot = F.get("slots", j) | (F.coalesce(F.get("wrapped_slots", j), F.lit(False)) & (item != doc))
        return F.struct(j.alias("j"), F.when(slot, item).alias("item_value"), F.when(slot, doc).alias("doc_value"))

    tokens = runs.join(items, "item_row").join(again, "row").select(
        "doc_id", "row", "item_id", "item_row", "kind", "offset", "first", "last", "windows", "span",
        F.explode(F.transform(F.sequence("first", "last"), token)).alias("token"),
    )
    # An occurrence lies at one distance, or within 4 of it where words were put in or left out: each
    # such stretch lies within one band of 8 of the two sets. The whole document is looked at as before.
    lane = lambda name, row, at: F.struct(F.lit(name).alias("lane"), row.alias("part"), at.cast("long").alias("band"))
    lanes = F.array(
        lane("whole", F.lit(0).cast("long"), F.lit(0)),
        lane("exact", F.col("row"), F.col("offset")),
        lane("near", F.col("row"), F.floor(F.col("offset") / 8)),
        lane("half", F.col("row"), F.floor((F.col("offset") + 4) / 8)),
    )
    tokens = tokens.withColumn("lane", F.explode(lanes))
    groups = tokens.groupBy("doc_id", "item_id", "item_row", "windows", "span", "kind", "lane").agg(
        F.countDistinct("token.j").alias("covered"), F.max(F.col("last") - F.col("first") + 1).alias("longest"),
        F.countDistinct(F.when(F.col("token.j") + F.col("span") - 1 <= F.col("last"), F.col("token.j"))).alias("matched"),
        F.countDistinct("token.item_value").alias("item_values"),
        F.countDistinct("token.item_value", "token.doc_value").alias("slot_values"),
    )
    exact = F.col("kind") == "plain"
    passed = (exact | (F.col("item_values") == F.col("slot_values")))
    passed = passed & (enough("matched") | ((F.col("lane.lane") != "whole") & ((F.col("covered") >= need) | (F.col("longest") >= RUN_TOKENS))))
    rank = F.when(~exact, 2).otherwise(0) + (F.col("lane.lane") == "whole").cast("int")
    best = groups.withColumn("rank", F.when(passed, rank)).groupBy("doc_id", "item_id").agg(
        F.max(F.when(F.col("rank").isNotNull(), F.struct("rank", "matched", "windows", "slot_values"))).alias("best"),
        F.max(F.when(~exact & (F.col("lane.lane") == "whole"), F.col("slot_values"))).alias("all_values"),
    )
    return best.filter(F.col("best").isNotNull()).select(
        "doc_id", "item_id", F.col("best.windows").cast("long").alias("windows"), F.col("best.matched").alias("matched"),
        F.when(F.col("best.rank") >= 2, F.col("best.slot_values")).otherwise(F.col("all_values")).alias("slot_values"),
        (F.col("best.rank") >= 2).alias("consistent"),
    )


# The same pairs in DuckDB's SQL over `documents` and `benchmark`: windows as strings, no pair is left out
# early, and a run is a count of hits in a row. The items of these tables all have a full window.
_TEMPLATE = """CASE WHEN t IN ('.', '!', '?', chr(10)) THEN '' WHEN t >= '0' AND t < ':' THEN '#num'
      WHEN t <> lower(t) AND regexp_matches(t, '^\\p{{Lu}}\\p{{Ll}}+$') AND {0} IS NOT NULL AND {0} NOT IN ('.', '!', '?', chr(10)) THEN '#name'
      WHEN {0} >= '0' AND {0} < ':' AND lower(t) IN ({1}) THEN '#unit' ELSE lower(t) END"""
_UNITS = ", ".join(f"'{u}'" for u in UNITS)

CHECK = rf"""
WITH t AS (
  SELECT 'd' AS side, doc_id AS id, hash(doc_id, text) AS k, regexp_extract_all(coalesce(text, ''), '{TOKEN}') AS raw FROM documents
  UNION
  SELECT 'b', item_id, hash(item_id, text), regexp_extract_all(coalesce(text, ''), '{TOKEN}') FROM benchmark
), u AS (
  SELECT side, id, k, unnest(raw) AS t, generate_subscripts(raw, 1) AS i, list_contains(raw, chr(10)) AS lines FROM t
), p AS (
  SELECT *, lag(t) OVER r AS b1, lag(t, 2) OVER r AS b2 FROM u WINDOW r AS (PARTITION BY side, k ORDER BY i)
), c AS (
  SELECT side, id, k, lines, lower(t) AS a, {_TEMPLATE.format("b1", _UNITS)} AS b,
    {_TEMPLATE.format("(CASE WHEN b1 = chr(10) THEN b2 ELSE b1 END)", _UNITS)} AS c,
    row_number() OVER (PARTITION BY side, k ORDER BY i) - 1 AS pos
  FROM p WHERE t NOT IN ('.', '!', '?', chr(10))
), v AS (
  SELECT side, id, k, pos, lines, string_agg(a, ' ') OVER r AS a, string_agg(b, ' ') OVER r AS b, string_agg(c, ' ') OVER r AS c,
    sum((b[1] = '#')::INT) OVER r AS nb, sum((c[1] = '#')::INT) OVER r AS nc, count(*) OVER r AS n
  FROM c WINDOW r AS (PARTITION BY side, k ORDER BY pos ROWS BETWEEN CURRENT ROW AND {SEED - 1} FOLLOWING)
), w AS (
  SELECT side, id, k, pos, a AS w, true AS literal FROM v WHERE n = {SEED}
  UNION ALL SELECT side, id, k, pos, b, false FROM v WHERE n = {SEED} AND nb BETWEEN 1 AND {SEED_HELD}
  UNION ALL SELECT side, id, k, pos, c, false FROM v WHERE n = {SEED} AND lines AND nc BETWEEN 1 AND {SEED_HELD} AND c <> b
), size AS (
  SELECT k, count(*) - {WINDOW - 1} AS windows FROM c WHERE side = 'b' GROUP BY k HAVING count(*) >= {WINDOW}
), hit AS (
  SELECT d.id AS doc_id, d.k AS dk, b.id AS item_id, b.k AS bk, d.pos - b.pos AS o, b.pos AS place, bool_or(b.literal) AS literal
  FROM w AS d JOIN w AS b ON d.w = b.w AND d.side = 'd' AND b.side = 'b' JOIN size ON size.k = b.k GROUP BY ALL
), kinds AS (
  SELECT *, 'any' AS kind FROM hit UNION ALL SELECT *, 'plain' FROM hit WHERE literal
), runs AS (
  SELECT *, count(*) OVER (PARTITION BY kind, dk, bk, o ORDER BY place RANGE BETWEEN CURRENT ROW AND {WINDOW - SEED} FOLLOWING) = {WINDOW - SEED + 1} AS whole,
    count(*) OVER (PARTITION BY kind, dk, bk, o ORDER BY place RANGE BETWEEN CURRENT ROW AND {RUN_TOKENS - SEED} FOLLOWING) = {RUN_TOKENS - SEED + 1} AS long
  FROM kinds
), covered AS (
  SELECT kind, doc_id, dk, item_id, bk, o, j, bool_or(whole AND j = place) AS whole, bool_or(long) AS long
  FROM (SELECT *, unnest(range(place, place + {SEED})) AS j FROM runs) GROUP BY ALL
), slots AS (
  SELECT r.*, i.a AS iv, x.a AS dv, (i.b[1] = '#' OR (i.lines AND i.c[1] = '#' AND i.a <> x.a)) AS slot
  FROM covered AS r JOIN c AS i ON i.side = 'b' AND i.k = bk AND i.pos = j JOIN c AS x ON x.side = 'd' AND x.k = dk AND x.pos = j + o
), lanes AS (
  SELECT *, unnest([{{'l': 'whole', 'p': 0::UBIGINT, 'q': 0::BIGINT}}, {{'l': 'exact', 'p': dk, 'q': o}},
    {{'l': 'near', 'p': dk, 'q': floor(o / 8.0)::BIGINT}}, {{'l': 'half', 'p': dk, 'q': floor((o + 4) / 8.0)::BIGINT}}]) AS lane FROM slots
), g AS (
  SELECT kind, doc_id, item_id, bk, lane, windows, count(DISTINCT j) AS n, bool_or(long) AS long, count(DISTINCT j) FILTER (whole) AS matched,
    count(DISTINCT iv) FILTER (slot) AS ivs, count(DISTINCT (iv, dv)) FILTER (slot) AS pairs
  FROM lanes JOIN size ON size.k = bk GROUP BY ALL
), ranked AS (
  SELECT *, (kind = 'any')::INT * 2 + (lane.l = 'whole')::INT AS rank, matched * 100 >= windows * {SHARE} OR matched >= {RUN} AS enough,
    n >= ceil(windows * {SHARE} / 100.0) + {WINDOW - 1} OR long AS passage
  FROM g
), best AS (
  SELECT doc_id, item_id, max((rank, matched, windows, pairs)) FILTER (kind = 'plain' OR ivs = pairs) AS b
  FROM ranked WHERE enough OR (lane.l <> 'whole' AND passage) GROUP BY ALL
), everywhere AS (
  SELECT doc_id, item_id, max(pairs) AS pairs FROM g WHERE kind = 'any' AND lane.l = 'whole' GROUP BY ALL
)
SELECT doc_id, item_id, b[3]::BIGINT AS windows, b[2]::BIGINT AS matched,
  CASE WHEN b[1] >= 2 THEN b[4] ELSE pairs END::BIGINT AS slot_values, b[1] >= 2 AS consistent
FROM best JOIN everywhere USING (doc_id, item_id) WHERE b IS NOT NULL
"""
