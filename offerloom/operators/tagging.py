"""Tag texts with the dictionary terms they contain as substrings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.operators.sizing import rows_if_small
from offerloom.operators.skew import CELL_PAIRS, grid_join, key_sizes
from offerloom.operators.substrings import member_lists

try:
    import ahocorasick
except ImportError:  # the join then serves every dictionary too large to scan for
    ahocorasick = None

# Up to this many terms, testing them one by one inside the JVM is cheapest.
SCAN_TERMS = 200
# Up to this many terms, the dictionary travels to every task.
BOUNDED_TERMS = 200_000
# Terms of an unbounded dictionary are looked up by so many characters; longer ones read the text again.
CARRIED = 64
# Hits are counted in one text of so many before they are joined; all texts are searched.
SIZED_SHARE = 64


def tags_by_scan(lowered: Column, terms: list[str]) -> Column:
    """Terms found in the lowercased text, in dictionary order; null text gives null."""
    if not terms:
        return F.when(lowered.isNotNull(), F.array().cast("array<string>"))
    candidates = [F.when(F.contains(lowered, F.lit(t)), F.lit(t)) for t in terms]
    return F.when(lowered.isNotNull(), F.array_compact(F.array(*candidates)))


def tags_by_automaton(lowered: Column, terms: list[str]) -> Column:
    """Same result in one pass over each text, whatever the number of terms."""

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        positions: dict[str, list[int]] = {}
        for at, term in enumerate(terms):
            positions.setdefault(term, []).append(at)
        everywhere = positions.pop("", [])
        automaton = ahocorasick.Automaton()
        for term, at in positions.items():
            automaton.add_word(term, tuple(at))
        if positions:
            automaton.make_automaton()
        for batch in batches:
            found = []
            for value in batch.to_pylist():
                if value is None:
                    found.append(None)
                    continue
                hits = set(everywhere)
                if positions:
                    for at in {found_at for _, found_at in automaton.iter(value)}:
                        hits.update(at)
                found.append([terms[i] for i in sorted(hits)])
            yield pa.array(found, type=pa.list_(pa.string()))

    # Nondeterministic to the optimizer: a filter on the tags must not repeat the search.
    return F.arrow_udf(find, "array<string>").asNondeterministic()(lowered)


def anchor_hits(texts: DataFrame, anchors: DataFrame, once: bool = False) -> DataFrame:
    """``(key, anchor)``: anchors that ``(key, text)`` may hold; one may come more than once.

    Every substring of an anchor's length is asked for in a Bloom filter of the anchors where
    the text is scanned, so that what leaves the scan is near to the hits. With ``once`` texts
    of one key give the hits of one of them; these move as one list for each text.
    """
    lists = member_lists(texts, anchors, "anchor")
    if once:
        lists = lists.dropDuplicates(["key"])
    if not anchors.where("anchor = ''").isEmpty():
        # The empty term is in every text.
        lists = lists.withColumn("members", F.array_append("members", F.lit("")))
    return lists.select("key", F.explode("members").alias("anchor"))


def tags_by_join(texts: DataFrame, terms: DataFrame, cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """``(key, tags)`` of the texts ``(key, text)`` that hold a term, for a dictionary of any size.

    Each term is anchored on its first ``CARRIED`` characters, most terms on all of them. Hits of
    anchors meet their terms in an equi-join, in which a common anchor is cut on both sides;
    only longer terms are compared with the text again. Texts of equal keys must be equal.
    ``texts`` may be read twice.
    """
    anchored = terms.select("pos", "skill", F.substring("skill", 1, CARRIED).alias("anchor")).distinct()
    if anchored.isEmpty():
        return texts.limit(0).select("key", F.array().cast("array<string>").alias("tags"))
    # Sizes only say which anchors to cut, so a share of the texts tells enough of them.
    share = texts.where(F.pmod(F.xxhash64("key"), F.lit(SIZED_SHARE)) == 0)
    held = key_sizes(anchor_hits(share, anchored), ["anchor"]).withColumn("n", F.col("n") * SIZED_SHARE)
    hits = anchor_hits(texts, anchored, once=True)
    found = grid_join(hits, anchored, ["anchor"], "key", "pos", cell_pairs, sizes=(held, key_sizes(anchored, ["anchor"])))
    found = found.select("key", "pos", "skill")
    if anchored.where(F.length("skill") > CARRIED).isEmpty():
        sure = found
    else:
        long = found.where(F.length("skill") > CARRIED).join(texts, "key").where(F.contains("text", "skill"))
        sure = found.where(F.length("skill") <= CARRIED).unionByName(long.select("key", "pos", "skill").distinct())
    # The tags of a text fit in one row by definition of the result. A long text may hit a term twice.
    pairs = F.array_sort(F.collect_set(F.struct("pos", "skill")))
    return sure.groupBy("key").agg(F.transform(pairs, lambda s: s["skill"]).alias("tags"))


def with_tags(
    df: DataFrame,
    id_col: str,
    text_col: str,
    terms: DataFrame,
    out_col: str = "skills",
    when: Column | None = None,
    bounded_terms: int | None = None,
) -> DataFrame:
    """Add the tag list. ``terms`` has ``pos`` and ``skill``; ``when`` limits the work.

    Rows are tagged by their text alone, so repeated and null ids are of no consequence
    on any route. A dictionary of more than ``bounded_terms`` terms is joined to the texts.
    """
    terms = terms.where("skill is not null").select("pos", "skill")
    most = BOUNDED_TERMS if bounded_terms is None else bounded_terms
    rows = rows_if_small(terms, min(SCAN_TERMS, most) if ahocorasick is None else most)
    if rows is None:
        shown = F.lower(text_col) if when is None else F.when(when, F.lower(text_col))
        keyed = df.withColumn("__text_key", F.unhex(F.md5(shown)))
        texts = keyed.select(F.col("__text_key").alias("key"), shown.alias("text")).where("key is not null")
        tagged = tags_by_join(texts, terms).select(F.col("key").alias("__own_key"), F.col("tags").alias(out_col))
        joined = keyed.join(tagged, F.col("__text_key") == F.col("__own_key"), "left").drop("__own_key")
        none = F.when(F.col("__text_key").isNotNull(), F.array().cast("array<string>"))
        return joined.withColumn(out_col, F.coalesce(out_col, none)).drop("__text_key")
    ordered = [r["skill"] for r in sorted(rows, key=lambda r: (r["pos"], r["skill"]))]
    text = F.col(text_col) if when is None else F.when(when, F.col(text_col))
    find = tags_by_scan if len(ordered) <= SCAN_TERMS else tags_by_automaton
    # A column of its own, so that a text is lowercased once and not once per term.
    lowered = df.withColumn("__lowered", F.lower(text))
    return lowered.withColumn(out_col, find(F.col("__lowered"), ordered)).drop("__lowered")
