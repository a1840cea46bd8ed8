"""Exact deduplication by distributed most-significant-digit radix partitioning.

A document's key string is its length in bytes followed by its bytes. Each level splits the groups
of the level before by their next digit, a run of bytes: the first level by the length and the first
bytes, each later one by a digit ``GROWTH`` times as long, so that a text of n bytes takes
log(n) levels. A group is finished when it is a singleton or its texts have ended; since the length
is the first digit, all texts of a group end together. Equality is by bytes alone, no digest.

Each level is a count with map-side combining and a join that gives each row its group: no task ever
holds a group, and a group of copies with a third of all rows costs one row of counts a task; the
join's large key is split at run time. Only rows of unfinished groups reach the next level.

Cases: a null text counts as empty. Of equal texts the row with the largest id stays; a null id ranks
below all others. Rows that agree in id and text are ties: one of them, no matter which, is kept, the
others are dropped. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import discard, hex_sha256, materialise

#: Bytes in the first digit, and the factor from one level's depth to the next.
FIRST = 32
GROWTH = 16


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        hex_sha256(text).alias("text_sha256"),
        F.octet_length(text).alias("bytes"),
        text.cast("binary").alias("rest"),
    )

    # Level 1: only the digits of groups with more than one row come back to the rows.
    digit = F.substring("rest", 1, FIRST)
    groups = materialise(
        docs.select(F.octet_length(text).alias("bytes"), F.substring(text.cast("binary"), 1, FIRST).alias("digit"))
        .groupBy("bytes", "digit")
        .count()
        .where("count > 1")
        .select("bytes", "digit", F.monotonically_increasing_id().alias("group")),
        "radix-groups",
    )
    split = (
        rows.withColumn("digit", digit)
        # Always a sort-merge join: the list of groups grows with the corpus, and a large group is split.
        .join(groups.hint("merge"), ["bytes", "digit"], "left")
        .select(
            "doc_id",
            "text_sha256",
            "bytes",
            "group",
            F.when(F.col("group").isNotNull(), F.expr(f"substring(rest, {FIRST + 1})")).alias("rest"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    level = materialise(split, "radix-level")
    discard(groups)
    done = [
        level.where("group IS NULL").select(
            "doc_id",
            F.col("doc_id").alias("keep_id"),
            F.lit(1).cast("long").alias("group_size"),
            F.lit(True).alias("kept"),
            "text_sha256",
        )
    ]
    active, depth = level.where("group IS NOT NULL"), FIRST

    while not active.isEmpty():
        width = depth * (GROWTH - 1)
        keyed = active.withColumn("digit", F.substring("rest", 1, width))
        depth += width
        counted = materialise(
            keyed.groupBy("group", "digit")
            .agg(
                F.count("*").alias("n"),
                F.max(F.struct("doc_id", "row")).alias("top"),
                (F.max("bytes") <= depth).alias("ended"),
            )
            .withColumn("next", F.monotonically_increasing_id()),
            "radix-groups",
        )
        level = materialise(
            keyed.join(counted.hint("merge"), ["group", "digit"]).select(
                "doc_id",
                "text_sha256",
                "bytes",
                F.when(~F.col("ended") & (F.col("n") > 1), F.col("next")).alias("group"),
                F.when(~F.col("ended") & (F.col("n") > 1), F.expr(f"substring(rest, {width + 1})")).alias("rest"),
                "row",
                "n",
                "top",
            ),
            "radix-level",
        )
        discard(counted)
        done.append(
            level.where("group IS NULL").select(
                "doc_id",
                F.col("top.doc_id").alias("keep_id"),
                F.col("n").alias("group_size"),
                (F.col("row") == F.col("top.row")).alias("kept"),
                "text_sha256",
            )
        )
        active = level.where("group IS NOT NULL").drop("n", "top")

    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
