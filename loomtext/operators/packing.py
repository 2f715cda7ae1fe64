"""Token streams as training batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import bytes as B
from loomtext.operators.bpe import pair_counts
from loomtext.operators.order import with_position
from loomtext.session import pinned


def batches_per_epoch(tokens: int, b: int, t: int) -> int:
    """Batches that also have their last target: none of fewer than b t + 1 tokens."""
    return max(0, tokens - 1) // (b * t)


def pack(docs: DataFrame, b: int, t: int, tokens: int | None = None) -> DataFrame:
    """(batch, row, x, y) of whole batches from (offset, ids): y is x shifted by one token.

    A row needs tokens r t .. r t + t. The ids are written once, so what made them ran once. Rows within one document
    are cut where it is; of the at most two rows in which it begins or ends, slices of at most t + 1 tokens are shuffled.
    A row's tokens are cut out once, and x and y from these.
    The tail that fills no batch is dropped. `tokens` is the stream's length, if it is known.
    """
    held = pinned(docs.select("offset", "ids"), "ids")  # no filter on ids: it would be pushed below joins and compute them twice
    if tokens is None:
        tokens = held.agg(F.max(F.col("offset") + F.size("ids"))).first()[0] or 0
    rows = batches_per_epoch(tokens, b, t) * b
    offset, last = F.col("offset"), F.col("offset") + F.size("ids")
    cut = lambda start, end: F.slice("ids", (start - offset + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))
    first, end = F.ceil(offset / t), F.least(F.floor((last - 1) / t), F.lit(rows))
    within = F.transform(F.sequence(first, end - 1), lambda r: F.struct(r.alias("r"), cut(r * t, r * t + t + 1).alias("w")))
    whole = held.where((F.size("ids") > 0) & (first < end)).select(F.explode(within).alias("e")).select("e.*")  # cut before the explode: a row is one slice

    def part(r):
        start = F.greatest(r * t, offset)
        return F.struct(r.alias("r"), start.alias("start"), cut(start, F.least(r * t + t + 1, last)).alias("part"))

    ends = F.array_distinct(F.array(first - 1, F.floor((last - 1) / t)))
    seam = F.filter(ends, lambda r: (r >= 0) & (r < rows) & ((r * t < offset) | (r * t + t + 1 > last)))
    parts = held.where(F.size("ids") > 0).select(F.explode(F.transform(seam, part)).alias("e")).select("e.*")
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "part"))), lambda e: e["part"]))
    seams = parts.groupBy("r").agg(joined.alias("w")).where(F.size("w") == t + 1)
    return whole.unionByName(seams).select(F.floor(F.col("r") / b).cast("long").alias("batch"), (F.col("r") % b).cast("int").alias("row"), F.slice("w", 1, t).alias("x"), F.slice("w", 2, t).alias("y"))


#: Tokens that a task of BatchStore.write sorts and writes.
TASK_TOKENS = 1 << 22


class BatchStore:
    """Batches under a folder, to be read by step: the cursor over an epoch's batches that wraps to the first.

    Rows lie in folders by `span`, a stretch of batches, so a step's filter leaves one folder, and within it sorted
    by batch, so that Parquet's statistics leave few row groups. A step is all that a reader must remember to go on.
    A row is kept as x and the last of y, as y is x shifted by one token. Batches are numbered without gaps, so rows
    are dealt to tasks by number: what packs them runs once, without a look at their distribution.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        about = spark.read.parquet(f"{path}/about").first()
        self.batches, self.rows, self.span = about["batches"], about["rows"], about["span"]

    @classmethod
    def write(cls, packed: DataFrame, path: str, batches: int, b: int, t: int, *, span_tokens: int = 1 << 24) -> BatchStore:
        span, stretch = max(1, span_tokens // (b * t)), max(1, TASK_TOKENS // (b * t))
        spark = packed.sparkSession
        kept = packed.select("batch", "row", "x", F.element_at("y", -1).alias("next"), F.floor(F.col("batch") / span).alias("span"))
        dealt = kept.repartitionById(max(1, -(-batches // stretch)), F.floor(F.col("batch") / stretch).cast("int"))
        dealt.sortWithinPartitions("span", "batch", "row").write.partitionBy("span").parquet(f"{path}/rows")  # by span first: else the writer sorts by it alone
        spark.range(1).select(F.lit(batches).cast("long").alias("batches"), F.lit(b).alias("rows"), F.lit(span).cast("long").alias("span")).write.parquet(f"{path}/about")
        return cls(spark, path)

    def _rows(self) -> DataFrame:
        kept = self.spark.read.schema("batch long, row int, x array<int>, next int, span long").parquet(f"{self.path}/rows")
        return kept.withColumn("y", F.concat(F.slice("x", F.lit(2), F.size("x") - 1), F.array("next")))

    def at(self, step: int) -> DataFrame:
        """(row, x, y) of a step's batch; no rows if there are no batches."""
        batch = step % max(1, self.batches)
        return self._rows().where((F.col("span") == batch // self.span) & (F.col("batch") == batch)).select("row", "x", "y")

    def between(self, first: int, last: int, *columns: Column) -> DataFrame:
        """(step, row, x, y) for the steps from first until last. No join: a row knows in which of them it is.

        `columns`, if given, come in place of x and y; they are computed once for a row, however many its steps are.
        """
        n = max(1, self.batches)
        rows = self._rows()
        if last - first < n:  # part of an epoch, which may go round its end
            low, high = first % n, (last - 1) % n
            inside = lambda c, a, z: F.col(c).between(a, z) if low <= high else (F.col(c) >= a) | (F.col(c) <= z)
            rows = rows.where(F.lit(last > first) & inside("span", low // self.span, high // self.span) & inside("batch", low, high))
        begin = F.lit(first) + F.pmod(F.col("batch") - first, F.lit(n))  # the first of the row's steps
        steps = F.when(begin < last, F.sequence(begin, F.lit(last - 1).cast("long"), F.lit(n).cast("long")))
        return rows.select("row", *(columns or ("x", "y")), steps.alias("steps")).select(F.explode("steps").alias("step"), F.col("*")).drop("steps")

    def after(self, step: int, count: int) -> DataFrame:
        """(step, row, x, y) of the `count` steps that follow `step`, where a reader stopped; -1 begins."""
        return self.between(step + 1, step + 1 + count)


def epoch_cycle(steps: DataFrame, batches: int) -> DataFrame:
    """(step, batch): the cursor over `batches` batches that wraps to 0; no rows if there are none."""
    return steps.where(F.lit(batches > 0)).select("step", F.expr(f"step % {max(1, batches)}").cast("long").alias("batch"))


def next_token_pairs(docs: DataFrame) -> DataFrame:
    """(id, next_id, cnt) over the stream of the bytes of (doc_id, text), counted within documents and across seams.

    Only one narrow row for each document goes through the join that finds its successor.
    """
    string = B.byte_string(F.col("text"))
    docs = docs.where(F.octet_length("text") > 0)
    seams = with_position(docs.select("doc_id", F.ascii(F.left(string, F.lit(1))).alias("first"), F.ascii(F.right(string, F.lit(1))).alias("last")), "doc_id")
    after = seams.select((F.col("position") - 1).alias("position"), F.col("first").alias("b"))
    across = seams.select("position", F.col("last").alias("a")).join(after, "position").groupBy("a", "b").agg(F.count("*").alias("cnt"))
    both = pair_counts(docs).unionByName(across)
    return both.groupBy(F.col("a").alias("id"), F.col("b").alias("next_id")).agg(F.sum("cnt").alias("cnt"))
