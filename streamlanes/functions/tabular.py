"""Table functions for SQL: what a stateful map that gives several rows for one would be."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="pos long, label string")
class ExpandMotif:
    """The labels of a motif's elements, from its start and length."""

    def eval(self, start: int, length: int) -> Iterator[tuple[int, str]]:
        for i in range(length or 0):
            yield start + i, "MID_MOTIF" if i else "MOTIF_BEGIN"


def register_functions(spark: SparkSession) -> None:
    """Make the table functions known to SQL: expand_motif(start, length)."""
    spark.udtf.register("expand_motif", ExpandMotif)
