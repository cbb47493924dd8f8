"""A key for each row of a documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def numbered(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, bool]:
    """``docs`` with a long column ``_logspark_row`` that is unique and in the order of
    doc_id, and whether it is the doc_id itself.

    With null or repeated doc_ids a sorted copy is written and numbered (null
    first, rows of one doc_id by a hash of their text).
    """
    doc_id = F.col("doc_id").cast("long")
    odd = docs.groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1).count()
    if not odd:
        return docs.withColumn("_logspark_row", doc_id), True
    ordered = docs.orderBy(doc_id, F.xxhash64("text"))
    return scratch.write(ordered.withColumn("_logspark_row", F.monotonically_increasing_id()), "numbered"), False
