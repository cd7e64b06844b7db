"""A kept dictionary of judged ingredient tokens.

The rules of a token read the token alone, but for one: a class word that names a flavour casts
doubt on the token behind it. So a token has two verdicts, and the place in its list says which
one counts. A refresh judges only tokens that the dictionary doesn't hold; rows then look their
tokens up. Each refresh adds one folder, which counts once its line in ``log`` is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelproof.operators import ingredients as I
from labelproof.operators.skew import join_key_stats, reliable

VERDICT = "struct<token: string, kind: string, severity: int, label: string>"
SCHEMA = f"token string, skip boolean, opens boolean, plain {VERDICT}, under {VERDICT}, gen int"


def judged(tokens: DataFrame) -> DataFrame:
    """The two verdicts of each ``token``, and whether it casts doubt on the next one."""
    token = F.col("token")
    df = tokens.select("token", I.is_class_or_noise(token).alias("skip"), I.opens_flavour(token).alias("opens"))

    def mark(under: bool):
        return F.struct("token", "skip", F.lit(under).alias("under_flavour"))

    df = df.withColumn("_marks", F.array(mark(False), mark(True)))
    df = I.judge_tokens(I.rank_tokens(df, "_marks", "_ranks"), "_ranks", "_items")
    return df.select("token", "skip", "opens", *[F.get("_items", F.lit(i)).cast(VERDICT).alias(n) for i, n in enumerate(("plain", "under"))])


class TokenDictionary:
    """The judged tokens in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def generations(self) -> list[int]:
        """The refreshes whose writing ended; one line each."""
        try:
            log = self.spark.read.schema("gen int").parquet(f"{self.folder}/log")
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return []
            raise
        return sorted(r["gen"] for r in log.collect())

    def read(self) -> DataFrame:
        """Every known token once."""
        of = self.generations()
        if not of:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.option("basePath", f"{self.folder}/tokens").schema(SCHEMA)
        return rows.parquet(*[f"{self.folder}/tokens/gen={g}" for g in of])

    def refresh(self, rows: DataFrame, tokens: str) -> int:
        """Judge the tokens of the lists that aren't known yet; how many there were."""
        of = self.generations()
        seen = rows.select(F.explode(tokens).alias("token")).distinct()
        new = reliable(seen.join(self.read().select("token"), "token", "left_anti"))
        count = new.count()
        if count:
            gen = of[-1] + 1 if of else 0
            judged(new).write.mode("overwrite").parquet(f"{self.folder}/tokens/gen={gen}")
            self.spark.range(1).select(F.lit(gen).alias("gen")).write.mode("append").parquet(f"{self.folder}/log")
        return count

    def look_up(self, rows: DataFrame, key: str, tokens: str, out: str) -> DataFrame:
        """``rows`` with the judged list of their tokens, which the dictionary must hold.

        ``key`` is unique. A token that many lists hold goes by broadcast; the place and the
        token before it are looked at in the list again.
        """
        each = reliable(rows.select(F.col(key).alias("_key"), F.posexplode(tokens).alias("_at", "token")))
        counts = each.groupBy("token").agg(F.count("*").alias("_weight"))
        known = reliable(self.read().drop("gen").join(counts, "token"))
        found = join_key_stats(each, known, "token", "_weight", F.concat_ws("\u0001", F.col("_key").cast("string"), "_at"))
        lists = found.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_at", "skip", "opens", "plain", "under"))).alias("_list"))
        before = lambda i: F.get("_list", i - 1)
        items = F.transform("_list", lambda t, i: F.when(before(i)["skip"] & before(i)["opens"], t["under"]).otherwise(t["plain"]))
        lists = lists.select("_key", items.alias(out))
        none = F.array().cast(f"array<{VERDICT}>")
        joined = rows.join(lists, rows[key] == lists["_key"], "left").drop("_key")
        return joined.withColumn(out, F.coalesce(out, none))

    def analyze_text(self, rows: DataFrame, key: str, text: str, out: str) -> DataFrame:
        """The evidence struct of an ingredient text column, by a refresh and a look-up."""
        listed = reliable(I.listed(rows, text))
        self.refresh(listed, "_tokens")
        return I.concluded(self.look_up(listed, key, "_tokens", "_items"), "_items", out)
