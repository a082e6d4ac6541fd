"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches. A batch's line hashes are counted, merge-anti-joined with what the runs have settled, and the
rest becomes a new run of level 0; as soon as a level has FAN runs they are merged to one run of the next level. A run is a
table bucketed and sorted by hash, so it joins a batch that is dealt out the same way without being moved.

A table's documents are taken from the largest doc_id down. A hash that the runs know from enough documents is settled:
its last holder is known, and no smaller doc_id changes what happens to it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beamframe.llm.shared import materialize, new_path

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of one level before they are merged.
FAN = 2
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Counts of line hashes over batches of documents: (h1, h2, n_docs, last), n_docs documents of which last is the largest id."""

    def __init__(self, spark: SparkSession, buckets: int, enough: int):
        self.spark, self.buckets, self.enough = spark, buckets, enough
        self.levels: list[list[str]] = [[]]
        self.tables: list[str] = []

    def _write(self, df: DataFrame) -> str:
        """df, which is dealt out by hash as the buckets are, as a run."""
        name = f"line_run_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", new_path(self.spark, "run")).format("parquet").saveAsTable(name)
        self.tables.append(name)
        return name

    def _merged(self, names: list[str]) -> DataFrame:
        """Runs put together by full merge joins; two runs meet in their buckets, without an exchange.

        No union: in Spark 4.1 one of bucketed columnar scans counts as dealt by hash, though its rows are not.
        """
        merged = self.spark.table(names[0])
        for name in names[1:]:
            a, b = merged.alias("a"), self.spark.table(name).hint("merge").alias("b")
            count = F.coalesce(F.col("a.n_docs"), F.lit(0)) + F.coalesce(F.col("b.n_docs"), F.lit(0))
            merged = a.join(b, [F.col(f"a.{h}") == F.col(f"b.{h}") for h in HASH], "full").select(*[F.coalesce(f"a.{h}", f"b.{h}").alias(h) for h in HASH], count.alias("n_docs"), F.greatest("a.last", "b.last").alias("last"))
        return merged

    def add(self, lines: DataFrame) -> None:
        """lines (doc_id, h1, h2) of documents that no other batch holds; each line of a document may stand there many times.

        A hash that the runs have settled adds nothing: with batches from the largest id down, its last holder stays right
        and its count is enough already.
        """
        own = lines.distinct().groupBy(*HASH).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last"))
        for k, name in enumerate(name for level in self.levels for name in level):
            settled = self.spark.table(name).where(F.col("n_docs") >= self.enough).select(*[F.col(h).alias(f"{h}_{k}") for h in HASH])
            # n_docs > 0 holds always; it keeps the join above the aggregate, where a hash is one row and lies in its bucket
            own = own.join(settled.hint("merge"), [F.col("h1") == F.col(f"h1_{k}"), F.col("h2") == F.col(f"h2_{k}"), F.col("n_docs") > 0], "left_anti")
        self.levels[0].append(self._write(own))
        self.compact()

    def compact(self) -> None:
        for k, level in enumerate(self.levels):
            if len(level) >= FAN:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._write(self._merged(level)))
                self.levels[k] = []

    def frequent(self) -> DataFrame:
        """(h1, h2, last) of the hashes that enough documents hold."""
        names = [name for level in self.levels for name in level]  # small ones first
        return self._merged(names).where(F.col("n_docs") >= self.enough).select(*HASH, "last")

    def close(self) -> None:
        """Take the runs out of the catalog; their files stay in the shared folder."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def long_lines(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, r1, r2, h1, h2, pos) of each line whose key has at least so many code points; r1, r2 tell the row's text, pos counts lines from 0."""
    text = docs.select("doc_id", F.xxhash64("text").alias("r1"), F.xxhash64(F.lit(1), "text").alias("r2"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line")).where(F.char_length("line") >= least)
    keyed = text.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= least)
    return keyed.select("doc_id", "r1", "r2", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "pos")


def drop_common_lines(docs: DataFrame, least: int = 40, enough: int = 5, batches: int = 4) -> DataFrame:
    """docs with columns n_lines, n_dropped and kept (the text that stays).

    Lines end at \\n; a null or empty text is one empty line. A line's key is the line without blanks at its ends, A-Z in
    lower case. Keys of at least `least` code points found in at least `enough` documents lose all their lines but those
    of the largest doc_id that holds them; several such lines of that document all stay.

    Rows of one doc_id, equal or not, are one document; rows without doc_id are one document that comes before all others.
    Very long texts are worked on line by line, and cut at the dropped lines only. Ties: none, as ids are compared. An
    empty table gives an empty result. Other columns pass through; names that this adds (n_lines, n_dropped, kept) replace
    columns of these names. Lines are told apart by 128 bits of hash.
    """
    spark = docs.sparkSession
    ends = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000).alias("ends")).first()["ends"] or []
    ends = sorted(set(ends))
    batch = sum([(F.col("doc_id") > e).cast("int") for e in ends], F.lit(0)) if ends else F.lit(0)
    lines = new_path(spark, "lines")
    own = long_lines(docs, least).withColumn("batch", F.coalesce(batch, F.lit(-1)))
    own.write.partitionBy("batch").option("compression", "zstd").parquet(lines)
    lines = spark.read.schema(own.schema).parquet(lines)

    runs = LineRuns(spark, int(spark.conf.get("spark.sql.shuffle.partitions")), enough)
    for k in range(len(ends), -2, -1):  # -1: rows without doc_id
        runs.add(lines.where(F.col("batch") == k).select("doc_id", *HASH))
    frequent = materialize(runs.frequent(), "frequent")
    runs.close()

    drops = lines.join(frequent, HASH).where(~F.col("doc_id").eqNullSafe(F.col("last")))
    cuts = drops.groupBy("doc_id", "r1", "r2").agg(F.array_sort(F.collect_set("pos")).alias("cuts"))
    cuts = cuts.select(F.col("doc_id").alias("__id"), F.col("r1").alias("__r1"), F.col("r2").alias("__r2"), F.col("cuts").alias("__cuts"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept")]
    rows = docs.select(*names, F.xxhash64("text").alias("__t1"), F.xxhash64(F.lit(1), "text").alias("__t2"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__t1") == F.col("__r1")) & (F.col("__t2") == F.col("__r2"))
    return rows.join(cuts, same, "left").select(*names, *_cut(F.split(F.coalesce("text", F.lit("")), "\n", -1), F.col("__cuts")))


def _cut(lines: Column, cuts: Column) -> list[Column]:
    """n_lines, n_dropped and kept: the runs of lines between cuts, each taken as a whole."""
    n, k = F.size(lines), F.coalesce(F.size(cuts), F.lit(0))
    before = lambda i: F.coalesce(F.get(cuts, i - 1), F.lit(-1))
    between = F.transform(F.sequence(F.lit(0), F.size(cuts)), lambda i: F.slice(lines, before(i) + 2, F.coalesce(F.get(cuts, i), n) - before(i) - 1))
    dropped = F.when(cuts.isNull(), 0).otherwise(k)
    kept = F.when(cuts.isNull(), F.array_join(lines, "\n")).otherwise(F.array_join(F.flatten(between), "\n"))
    return [n.cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"), kept.alias("kept")]


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    found = drop_common_lines(docs.select("doc_id", "text"), **options)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
