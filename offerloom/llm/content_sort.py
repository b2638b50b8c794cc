"""Exact deduplication by sorting content, in DataFrame functions only.

Texts are normalised: every run of ASCII white space becomes one space. Spark samples
splitters of ``(head, mark, piece)`` and deals the normalised texts by range, each partition
sorts its rows externally, equal texts then are neighbours, and the window that follows
compares whole neighbouring texts to tell where a group ends. ``head`` is the beginning of
the text and ``mark`` a hash that only places the text: both bound what the splitters hold,
however long the texts are, and neither decides whether texts are equal.

Copies of a text that has many of them are dealt over several pieces, so that no group,
whatever share of the table it holds, is sorted in one task. The firsts of such pieces, one
row each, are compared once more, whole texts again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerloom.llm.common import staged

#: Runs of white space other than a single space; replacing those by one space replaces all.
_GAPS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
#: Characters of a text that its splitters may hold.
HEAD = 32
#: Copies of one text beyond so many rows, or bytes, are sorted in several pieces.
PIECE_ROWS, PIECE_BYTES = 4_096, 16 << 20
#: So many texts, those with the most pieces, are cut: what is broadcast has this bound, and
#: a group left whole holds less than one part in so many of the table.
MOST_CUT = 100_000


def normalised(text: Column) -> Column:
    """The text with every run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _GAPS, " ")


def cut_texts(rows: DataFrame, piece_rows: int, piece_bytes: int) -> DataFrame:
    """``(own, pieces)``: marks of texts with many copies, and the pieces they are dealt to."""
    copies = rows.groupBy(F.col("mark").alias("own")).agg(
        F.count("*").alias("rows"), F.sum(F.octet_length("norm")).alias("bytes")
    )
    asked = F.greatest(F.ceil(F.col("rows") / piece_rows), F.ceil(F.col("bytes") / piece_bytes))
    pieces = copies.select("own", F.least("rows", asked).cast("int").alias("pieces")).where("pieces > 1")
    return staged(pieces.orderBy(F.desc("pieces"), "own").limit(MOST_CUT), "content-cut")


def _neighbours(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` dealt by range and sorted, with place, first id and size of each group."""
    dealt = rows.repartitionByRange(*by)
    # The range of a row decides that of its group, so the window needs no exchange of its own.
    group = Window.partitionBy(*by, "norm")
    place = group.orderBy(F.col("id").asc_nulls_last())
    return dealt.select(
        "*", F.row_number().over(place).alias("place"), F.first("id").over(place).alias("first"),
        F.count("*").over(group).alias("size"),
    )


def marked_copies(
    docs: DataFrame, row: Column | None = None, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES
) -> DataFrame:
    """``(row, id, keep_id, size, kept, sha256)``: one row for each row of ``docs``.

    ``row`` is carried along, null if not given. ``piece_rows`` and ``piece_bytes`` steer cost
    only.
    """
    rows = docs.select(
        (F.lit(None) if row is None else row).alias("row"), F.col("doc_id").cast("bigint").alias("id"),
        normalised(F.col("text")).alias("norm"),
    )
    rows = rows.select("*", F.xxhash64("norm").alias("mark"), F.substring("norm", 1, HEAD).alias("head"))
    cut = cut_texts(rows, piece_rows, piece_bytes)
    several = not cut.isEmpty()
    if several:
        rows = rows.join(F.broadcast(cut), F.col("mark") == F.col("own"), "left").drop("own")
        dealt = F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")
        rows = rows.select("*", F.when(F.col("pieces").isNotNull(), dealt).otherwise(0).alias("piece"))
    else:
        rows = rows.select("*", F.lit(None).cast("int").alias("pieces"), F.lit(0).alias("piece"))
    # The text itself is needed further for the firsts of pieces only.
    head = F.col("pieces").isNotNull() & (F.col("place") == 1)
    found = _neighbours(rows, ["head", "mark", "piece"] if several else ["head", "mark"]).select(
        "row", "id", "first", "size", "place", "piece", "pieces", F.sha2("norm", 256).alias("sha256"),
        F.when(head, F.col("norm")).alias("norm"),
    )
    if not several:
        return found.select("row", "id", F.col("first").alias("keep_id"), "size", (F.col("place") == 1).alias("kept"), "sha256")
    found = staged(found, "content-pieces")
    # One row for each piece: at most a few for each text that was cut.
    firsts = found.where(head).groupBy("sha256", "norm").agg(
        F.min(F.struct(F.col("first").isNull(), F.col("first").alias("id"), "piece")).alias("least"),
        F.sum("size").alias("total"),
    )
    firsts = firsts.select(F.col("sha256").alias("own"), F.col("least.id").alias("least"), F.col("least.piece").alias("at"), "total")
    joined = found.join(F.broadcast(staged(firsts, "content-firsts")), F.col("sha256") == F.col("own"), "left")
    whole = F.col("pieces").isNull()
    return joined.select(
        "row", "id", F.when(whole, F.col("first")).otherwise(F.col("least")).alias("keep_id"),
        F.when(whole, F.col("size")).otherwise(F.col("total")).alias("size"),
        ((F.col("place") == 1) & (whole | (F.col("piece") == F.col("at")))).alias("kept"), "sha256",
    )


def copy_groups(docs: DataFrame) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` of every row.

    Of equal texts the row with the smallest doc_id is kept, a null doc_id only where no other
    is; of rows that repeat that doc_id one is. Null and empty texts are equal, a text of
    white space only is one space and unlike them. Other columns are ignored; an empty table
    gives no rows.
    """
    found = marked_copies(docs)
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", F.col("size").alias("group_size"), "kept",
        F.col("sha256").alias("text_sha256"),
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The kept rows of ``docs`` with all their columns, whatever their names."""
    found = marked_copies(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    return found.where("kept").select("row.*")


ORACLE_SQL = r"""
WITH n AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM n
"""
