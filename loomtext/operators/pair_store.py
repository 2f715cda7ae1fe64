"""Pair counts that follow a changing corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators.bpe import pair_counts
from loomtext.session import small_side

SUMS = "a int, b int, cnt long"


def changes(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """(text, sign) of the rows in which two versions of a table differ: 1 for what came, -1 for what went.

    Rows are the same if key and text are, nulls included; repeated rows count as often as they stand there. Versions
    are compared by digests, so texts are shuffled only if too many differ to be broadcast.
    """
    side = lambda df, sign: df.select(F.col(key).alias("key"), "text", F.sha2("text", 256).alias("digest"), F.lit(sign).alias("sign"))
    both = side(old, -1).unionByName(side(new, 1))
    differ = both.groupBy("key", "digest").agg(F.sum("sign").alias("net")).where("net <> 0").select(F.col("key").alias("__key"), F.col("digest").alias("__digest"))
    return both.join(small_side(differ), F.col("key").eqNullSafe(F.col("__key")) & F.col("digest").eqNullSafe(F.col("__digest")), "left_semi").select("text", "sign")


class PairStore:
    """Counts of adjacent UTF-8 bytes under a folder: changes add to them and subtract from them.

    A change is kept as the signed sums of its own texts, so the corpus isn't read again. Changes are numbered
    upwards; a number that isn't above the last one is a repeat and alters nothing, so a change that is delivered
    twice, after a lost driver say, counts once. A change or a fold that broke off left no _SUCCESS and isn't read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _numbers(self, kind: str) -> list[int]:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/*/_SUCCESS")
        return sorted(int(f.getPath().getParent().getName()) for f in pattern.getFileSystem(conf).globStatus(pattern) or ())

    @property
    def last(self) -> int:
        """The number of the last change, -1 before the first."""
        return max([-1, *self._numbers("changes")[-1:], *self._numbers("folds")[-1:]])

    def apply(self, number: int, changed: DataFrame) -> bool:
        """Counts (text, sign), sign being 1 or -1 (null: 0), as change `number`; False if that is a repeat."""
        if number <= self.last:
            return False
        pair_counts(changed.select("text", F.coalesce("sign", F.lit(0)).alias("sign")), weight="sign").where("cnt <> 0").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/changes/{number}")
        return True

    def counts(self) -> DataFrame:
        """(a, b, cnt) of the corpus as it is; a pair that was taken away more often than it came raises."""
        folds = self._numbers("folds")[-1:]
        later = [n for n in self._numbers("changes") if n > max([-1, *folds])]
        paths = [f"{self.path}/folds/{n}" for n in folds] + [f"{self.path}/changes/{n}" for n in later]
        rows = self.spark.read.schema(SUMS).parquet(*paths) if paths else self.spark.createDataFrame([], SUMS)
        sums = rows.groupBy("a", "b").agg(F.sum("cnt").alias("cnt")).where("cnt <> 0")
        below = F.raise_error(F.concat_ws(" ", F.lit("more was taken away than there was of the pair"), "a", "b"))
        return sums.select("a", "b", F.when(F.col("cnt") < 0, below).otherwise(F.col("cnt")).alias("cnt"))

    def fold(self) -> None:
        """Sums all changes into one table, which is read in their place; theirs stay until they are deleted."""
        last = self.last
        if last >= 0 and last not in self._numbers("folds"):
            self.counts().coalesce(1).write.mode("overwrite").parquet(f"{self.path}/folds/{last}")
