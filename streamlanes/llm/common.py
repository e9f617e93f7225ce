"""What the operators share: words, shared storage, staged tables, connected components."""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, to Spark's and Java's regular expressions. ``bytes.split()`` finds the same words in UTF-8.
WORD = r"[^\x20\x09-\x0D]+"

#: Shared folder where a session on one machine names none, as in tests.
LOCAL_SHARED = "/tmp/streamlanes-shared"


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case, as UTF-8. Unpaired surrogates cannot come from Spark."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: that of spark.checkpoint.dir, which a cluster must name."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or LOCAL_SHARED).rstrip("/")


class Workspace:
    """A folder of its own below the shared one, removed when the driver ends.

    ``stage`` writes a table there and reads it back: the lineage ends at files that outlive any executor, and what
    was computed is not computed again.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/streamlanes/{purpose}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        atexit.register(_remove, spark, self.path)

    def of(self, name: str) -> str:
        return f"{self.path}/{name}"

    def stage(self, df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
        """``batch_rows``: rows of an Arrow batch at most; it ends after ``BATCH_BYTES`` too."""
        with arrow_batches(self.spark, batch_rows):
            df.write.option("compression", "zstd").parquet(self.of(name))
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(self.of(name))

    def drop(self, name: str) -> None:
        """Remove a staged table that nothing reads any more."""
        self.names.discard(name)
        _remove(self.spark, self.of(name))

    def keep(self, *prefixes: str) -> None:
        """Remove all staged tables but those whose names begin so."""
        for name in [n for n in self.names if not n.startswith(prefixes)]:
            self.drop(name)


#: Bytes after which an Arrow batch of a staged table ends, whatever its rows.
BATCH_BYTES = "16m"


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, rows: int | None):
    """Within it, Arrow batches hold so many rows at most, and so many bytes that very long texts come a few at a time."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows) if rows else None, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {k: spark.conf.get(k, None) for k, v in wanted.items() if v}
    for k in before:
        spark.conf.set(k, wanted[k])
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    except Exception:  # the session may have ended; what stays is a folder of temporary files
        pass


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, n: int):
    """crc32 of an id as text, modulo n: the fold a row belongs to (null for a null id)."""
    return F.crc32(F.col(column).cast("string")) % n


def connected_components(ws: Workspace, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long), component being the smallest node reachable.

    Alternating large-star and small-star (Kiveris et al. 2014): every round is aggregations and joins on the node, so
    no component is ever gathered in one place, and rounds grow with the logarithm of its size. Each round is staged in
    shared storage. Nodes without an edge to another node do not appear.
    """
    work = ws.stage(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        f"{name}-0",
    )
    before, turn = None, 0
    while True:
        # Stars are done when every u points at one v, and no v points anywhere.
        state = work.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if before == (tuple(state), True) or state[0] == 0:
            break
        both = work.union(work.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct()
        )
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(small_low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct()
        )
        turn += 1
        following = ws.stage(small, f"{name}-{turn}")
        after = following.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        before = (tuple(after), tuple(after) == tuple(state))
        work = following
        ws.drop(f"{name}-{turn - 1}")
    return work.select(F.col("u").alias("node"), F.col("v").alias("component"))
