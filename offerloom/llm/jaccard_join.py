"""Jaccard similarity join of word shingles: a size-aware heavy-light join.

Equal sets form one class first. Two sets that link share at least as many shingles as
the threshold asks of the larger one. *Light* sets name every subset of their own that
large, so two light sets that link name one in common. *Heavy* sets are found in
inverted lists: shingles have one global order, and two sets that link share one among
the first ``n - need + 1`` of each, so only those stand in the lists. The boundary
between light and heavy is where enumeration begins to cost more than scanning.

The order puts shingles of long lists last (any order that all sets share is exact), so
a passage that many documents hold does not make long lists. Within a list every set
meets a leader first; only sets that this leaves in different components meet each
other. So a group of thousands of near copies does not become pairs, and no link is lost.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.llm.bytesview import SLICE_BYTES, Words, bytes_of, mixed, shingles
from offerloom.llm.common import staged
from offerloom.llm.components import components
from offerloom.llm.encode import slices
from offerloom.operators.sizing import broadcast_if_small

#: A list longer than this moves its shingle to the end of the order; so many can move.
#: Both steer cost only: the result is the same for every choice.
LONG_LIST = 40
MOST_MOVED = 200_000
ROUNDS = 6
#: So many of its first keys a set shows at its later ones, to tell a pair once.
#: It steers cost only: a pair is never passed over at its first common key.
FIRST_KEYS = 64
SIGNS = ("p0", "p1", "p2", "p3")
#: No set above this size is enumerated, whatever the costs.
LIGHT_MOST = 20


def needed(n: int, num: int, den: int) -> int:
    """Least overlap of a set of ``n`` with any set it links to."""
    return -(-num * n // den)


def subset_count(n: int, num: int, den: int) -> int:
    return sum(math.comb(n, r) for r in range(n - needed(n, num, den) + 1))


def sets_of(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, words lower-cased in A-Z."""
    data, bounds = bytes_of(texts)
    hashes, edges = shingles(Words(data, bounds, lower=True), k)
    return [np.unique(hashes[a:b]) for a, b in zip(edges[:-1], edges[1:])]


def class_of(elements: np.ndarray) -> int:
    """One number for equal sets, from the sum of their mixed elements and their size."""
    total = mixed(elements + np.uint64(0x5EED)).sum(dtype=np.uint64, keepdims=True)
    return int(mixed(total + np.uint64(len(elements))).view(np.int64)[0])


def prefix(elements: np.ndarray, last: np.ndarray, num: int, den: int, wide: int = 1) -> np.ndarray:
    """The first elements in the order: by number, those in ``last`` after all others.

    ``wide`` takes that many times as many elements as a link needs to show one in common.
    """
    most = wide * (len(elements) - needed(len(elements), num, den) + 1)
    if not len(last):
        return elements[:most]
    at = np.minimum(np.searchsorted(last, elements), len(last) - 1)
    late = last[at] == elements
    return np.concatenate([elements[~late], elements[late]])[:most]


def subset_keys(elements: np.ndarray, num: int, den: int) -> np.ndarray:
    """A key of every subset that holds at least the needed overlap."""
    marked = mixed(elements ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    total, n, out = marked.sum(dtype=np.uint64), len(elements), []
    with np.errstate(over="ignore"):
        for left_out in range(n - needed(n, num, den) + 1):
            for gone in itertools.combinations(range(n), left_out):
                out.append(total - marked[list(gone)].sum(dtype=np.uint64) + np.uint64(n - left_out))
    return mixed(np.array(out, np.uint64))


def row_key() -> Column:
    """128 bits of a row's id and text. Rows that share it are equal in both."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))


def document_classes(docs: DataFrame, k: int) -> DataFrame:
    """``(doc_id, row, n, class)`` of every row; class is null for an empty set."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                found = sets_of(part.column("text"), k)
                own = pa.array([class_of(s) if len(s) else None for s in found], pa.int64())
                sizes = pa.array([len(s) for s in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row"), sizes, own], names=["doc_id", "row", "n", "class"]
                )

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("row"), "text")
    return source.mapInArrow(signed, "doc_id long, row string, n long, class long")


def class_sets(docs: DataFrame, wanted: DataFrame | None, k: int, first: Callable | None = None) -> DataFrame:
    """``(class, n, elements)`` of the classes whose ``(rep, rep_class)`` is in ``wanted``.

    ``first`` may choose the elements to return. A class stands there once for each row that
    repeats its representative, and once for each row where nothing is said of ``wanted``.
    """

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                found = sets_of(part.column("text"), k)
                shown = [first(s) if first else s for s in found]
                flat = np.concatenate([np.zeros(0, np.uint64), *shown]).view(np.int64)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in shown])]).astype(np.int32)
                own = pa.array([class_of(s) if len(s) else None for s in found], pa.int64())
                sizes = pa.array([len(s) for s in found], pa.int64())
                sets = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [own, sizes, sets, part.column("rep_class")], names=["class", "n", "elements", "rep_class"]
                )

    if wanted is None:
        texts = docs.select("text", F.lit(None).cast("long").alias("rep_class"))
    else:
        texts = docs.select("text", row_key().alias("row"))
        texts = texts.join(broadcast_if_small(wanted, text_cols=("rep",)), F.col("row") == F.col("rep"))
    found = texts.select("text", "rep_class").mapInArrow(
        signed, "class long, n long, elements array<long>, rep_class long"
    )
    if wanted is None:
        return found.where(F.col("class").isNotNull()).drop("rep_class")
    return found.where(F.col("class") == F.col("rep_class")).drop("rep_class")


def shared_entries(entries: DataFrame) -> DataFrame:
    """``(class, key, sets)`` of the keys that stand in more than one class; one shuffle."""
    dealt = entries.repartition("key")
    counted = dealt.groupBy("key").agg(F.count("*").alias("sets"), F.min("class").alias("lo"), F.max("class").alias("hi"))
    return dealt.join(counted.where("lo < hi"), "key").select("class", "key", "sets")


def parities(elements: np.ndarray) -> np.ndarray:
    """Whether the number of elements is odd, for each of 256 shares of them, as four numbers.

    Two sets differ in at least as many elements as their parities differ in bits.
    """
    odd = np.bincount((elements >> np.uint64(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def list_entries(sets: DataFrame, moved: np.ndarray, num: int, den: int, light: int) -> DataFrame:
    """``(class, n, key, p0..p3)``: subset keys of light sets, list entries of others.

    A light set that may link with a heavy one stands in the lists too.
    """
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("elements")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            sizes = batch.column("n").to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            keys, signs = [], []
            for n, end in zip(sizes.tolist(), ends.tolist()):
                own = np.sort(flat[end - n : end])
                part = [subset_keys(own, num, den)] if n <= light else []
                if n > light or den * n >= num * (light + 1):
                    part.append(prefix(own, moved, num, den))
                keys.append(np.unique(np.concatenate(part)))
                signs.append(parities(own))
            counts = [len(x) for x in keys]
            sign = np.repeat(np.array(signs, np.int64).reshape(-1, 4), counts, axis=0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(batch.column("class").to_numpy(zero_copy_only=False), counts)),
                    pa.array(np.repeat(sizes, counts)),
                    pa.array(np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)),
                    *[pa.array(np.ascontiguousarray(sign[:, i])) for i in range(4)],
                ],
                names=["class", "n", "key", *SIGNS],
            )

    signs = ", ".join(f"{p} long" for p in SIGNS)
    return sets.mapInArrow(entries, f"class long, n long, key long, {signs}")


def light_boundary(sizes: DataFrame, scan: float, num: int, den: int) -> int:
    """The size up to which naming subsets costs less than scanning lists of ``scan`` sets."""
    counts = {r["n"]: r["sets"] for r in sizes.where(F.col("n") <= LIGHT_MOST).collect()}
    gain = best = at = 0
    for n in range(1, LIGHT_MOST + 1):
        gain += counts.get(n, 0) * ((n - needed(n, num, den) + 1) * scan - subset_count(n, num, den))
        if gain >= best:
            best, at = gain, n
    return at


def _long_lists(shared: DataFrame) -> np.ndarray:
    """Keys of the longest lists, ``MOST_MOVED`` at most."""
    keys = shared.where(F.col("sets") > LONG_LIST).groupBy("key").agg(F.max("sets").alias("sets"))
    rows = keys.orderBy(F.desc("sets"), "key").limit(MOST_MOVED).select("key").collect()
    return np.array([r["key"] for r in rows], np.int64).view(np.uint64)


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs ``(a, b)`` of classes whose sets meet the threshold, by exact intersection."""
    left = sets.select(F.col("class").alias("a"), F.col("elements").alias("left"))
    right = sets.select(F.col("class").alias("b"), F.col("elements").alias("right"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("left", "right"))
    total = F.size("left") + F.size("right")
    return both.where((num + den) * shared >= num * total).select("a", "b")


def _may_link(a: str, b: str, num: int, den: int) -> Column:
    """Whether sizes ``{a}n`` and parities ``{a}p0..`` leave the pair a chance to link."""
    m, n = F.col(f"{a}n"), F.col(f"{b}n")
    # An overlap of o makes a difference of m + n - 2 * o elements.
    most = (m + n) - 2 * F.ceil(num * (m + n) / (num + den))
    seen = sum((F.bit_count(F.col(f"{a}{p}").bitwiseXOR(F.col(f"{b}{p}"))) for p in SIGNS), F.lit(0))
    return (den * m >= num * n) & (den * n >= num * m) & (seen <= most)


def _unlike_lists(named: DataFrame) -> DataFrame:
    """``key``: of lists that hold the same sets, the one with the first key.

    Texts that share a passage share a list for each of its shingles; one of those tells all of
    their pairs. Lists are compared by their sizes and two sums of hashes.
    """
    def total(seed: int) -> Column:
        return F.sum(F.xxhash64("class", F.lit(seed)).cast("decimal(38,0)"))

    lists = named.groupBy("key").agg(F.count("*").alias("sets"), total(1).alias("one"), total(2).alias("two"))
    return lists.groupBy("sets", "one", "two").agg(F.min("key").alias("key")).select("key")


def _with_earlier(named: DataFrame) -> DataFrame:
    """Add ``earlier``: those of the first ``FIRST_KEYS`` keys of a row's set that come before its key.

    Sets that show an earlier key in common are told there, so a pair of large sets that share a
    long passage does not become a row for each shingle of it.
    """
    keys = F.slice(F.sort_array(F.collect_list("key")), 1, FIRST_KEYS)
    firsts = named.groupBy(F.col("class").alias("own")).agg(keys.alias("firsts"))
    found = named.join(firsts, F.col("class") == F.col("own"))
    return found.withColumn("earlier", F.filter("firsts", lambda x: x < F.col("key"))).drop("own", "firsts")


def links(sets: DataFrame, entries: DataFrame, num: int, den: int) -> DataFrame:
    """Edges ``(a, b)`` between classes that give the components of all links."""
    dealt = entries.repartition("key")
    lead = F.struct(F.xxhash64("class", "key").alias("h"), "class", "n", *SIGNS)
    leaders = dealt.groupBy("key").agg(
        F.min(lead).alias("lead"), F.min("class").alias("lo"), F.max("class").alias("hi")
    )
    leaders = leaders.where(F.col("lo") < F.col("hi")).select(
        F.col("key").alias("own_key"), F.col("lead.class").alias("lead_class"),
        *[F.col(f"lead.{c}").alias(f"lead_{c}") for c in ("n", *SIGNS)],
    )
    listed = staged(dealt.join(leaders, F.col("key") == F.col("own_key")).drop("own_key"), "jaccard-listed")
    star = listed.where((F.col("class") != F.col("lead_class")) & _may_link("", "lead_", num, den))
    star = star.select(F.least("class", "lead_class").alias("a"), F.greatest("class", "lead_class").alias("b"))
    first = staged(_verified(star.distinct(), sets, num, den), "jaccard-links")
    named = listed.join(components(first), F.col("class") == F.col("node"), "left")
    named = named.select("key", "class", "n", *SIGNS, F.coalesce("root", "class").alias("root"))
    # Lists whose sets are all in one component have nothing left to compare.
    open_keys = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    open_keys = open_keys.where(F.col("lo") < F.col("hi")).select("key")
    named = staged(named.join(open_keys, "key", "left_semi").dropDuplicates(["class", "key"]), "jaccard-open")
    named = staged(_with_earlier(named.join(_unlike_lists(named), "key", "left_semi")), "jaccard-cross")
    other = named.select(*[F.col(c).alias(f"b_{c}") for c in named.columns])
    cross = named.join(
        other,
        (F.col("key") == F.col("b_key")) & (F.col("class") < F.col("b_class")) & (F.col("root") != F.col("b_root"))
        & _may_link("", "b_", num, den) & ~F.arrays_overlap("earlier", "b_earlier"),
    ).select(F.col("class").alias("a"), F.col("b_class").alias("b"))
    second = _verified(cross.distinct(), sets, num, den)
    return first.unionByName(staged(second, "jaccard-links"))


def _with_partner(classes: DataFrame, shared: DataFrame, num: int, den: int) -> DataFrame:
    """``(rep, rep_class)`` of the classes that may link, by their shared first elements.

    Two sets that link have one of their first ``p`` elements in common, and one more for each
    further element: of twice ``p`` they share ``p + 1``, or all but ``p - 1`` of a smaller set.
    A smaller partner may have a smaller ``p`` and shows no more than twice that.
    """
    counted = shared.groupBy("class").agg(F.count_distinct("key").alias("held")).withColumnRenamed("class", "own")
    least = F.ceil(F.col("n") * num / den)
    p, least_p = F.col("n") - least + 1, least - F.ceil(least * num / den) + 1
    wanted = classes.join(counted, F.col("class") == F.col("own"))
    wanted = wanted.where(F.col("held") >= 1 + F.least(p, F.col("n") - p, 2 * least_p - 1))
    return staged(wanted.select("rep", F.col("class").alias("rep_class")), "jaccard-wanted")


def row_groups(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, row, n, class)`` of every row, and ``(class, least, root)`` of the classes that
    have several rows or links: ``root`` names the component, ``least`` the smallest doc_id of
    the class."""
    rows = staged(document_classes(docs, k), "jaccard-rows")
    classes = rows.where("class is not null").groupBy("class").agg(
        F.min("row").alias("rep"), F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.min("n").alias("n")
    )
    classes = staged(classes, "jaccard-classes")
    none = np.zeros(0, np.uint64)
    firsts = class_sets(docs, None, k, lambda s: prefix(s, none, num, den, wide=2))
    shared = staged(shared_entries(firsts.select("class", F.explode("elements").alias("key"))), "jaccard-shared")
    mass = shared.agg(F.sum("sets").alias("s"), F.count("*").alias("n")).first()
    sizes = classes.groupBy("n").agg(F.count("*").alias("sets"))
    light = light_boundary(sizes, (mass["s"] or 0) / (mass["n"] or 1), num, den)
    # Sets that link, light ones too, share first elements in every order; those that do not
    # leave. Moving long lists to the end of the order leaves ever fewer, as long as it pays.
    moved, more = np.zeros(0, np.uint64), _long_lists(shared)
    wanted = _with_partner(classes, shared, num, den)
    before, left = math.inf, wanted.count()
    for _ in range(ROUNDS):
        more = np.setdiff1d(more, moved)
        if not len(more) or len(moved) + len(more) > MOST_MOVED or left > 0.8 * before:
            break
        moved = np.sort(np.concatenate([moved, more]))
        firsts = class_sets(docs, wanted, k, lambda s, last=moved: prefix(s, last, num, den, wide=2))
        shared = staged(shared_entries(firsts.select("class", F.explode("elements").alias("key"))), "jaccard-shared")
        more, wanted = _long_lists(shared), _with_partner(classes, shared, num, den)
        before, left = left, wanted.count()
    sets = staged(class_sets(docs, wanted, k), "jaccard-sets")
    listed = list_entries(sets, moved, num, den, light)
    roots = staged(components(links(sets, listed, num, den)), "jaccard-roots")
    joined = classes.select("class", "least", "copies").join(
        roots.select(F.col("node").alias("class"), "root"), "class", "left"
    )
    grouped = joined.where((F.col("copies") > 1) | F.col("root").isNotNull())
    return rows, staged(grouped.select("class", "least", F.coalesce("root", "class").alias("root")), "jaccard-groups")


def jaccard_components(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row.

    Rows link when ``den * |A and B| >= num * |A or B|`` of their sets of ``k``-word
    shingles; a text of fewer words is one shingle. A null text and a text without words
    have an empty set and link with nothing. ``component_id`` is the smallest doc_id
    reachable, a null one only where no other is. Repeated rows are copies of each other.
    Other columns are ignored; an empty table gives no rows. Shingles and equal sets are
    compared by 64-bit hashes.
    """
    rows, grouped = row_groups(docs, k, num, den)
    firsts = grouped.groupBy("root").agg(F.min("least").alias("first"))
    answer = grouped.join(firsts, "root").select("class", "first")
    return rows.join(broadcast_if_small(staged(answer, "jaccard-answer")), "class", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id")
    )


def one_of_each_group(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates, and all rows of no group.

    Of a group the row with the smallest doc_id stays, a null one only where no other is; of
    rows that share that id one text's, and of equal rows one. Whether a row goes depends on
    its own text, never on others that share its id. Columns may have any names.
    """
    rows, grouped = row_groups(docs, k, num, den)
    members = rows.join(broadcast_if_small(grouped.select("class", "root")), "class").select("doc_id", "row", "root")
    members = staged(members, "jaccard-members")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    kept = members.groupBy("root").agg(F.min(order).alias("first")).select("first.row").withColumn("stays", F.lit(True))
    each = members.groupBy("row").agg(F.count("*").alias("equal")).join(kept, "row", "left")
    # Marked are rows that go, and those that stay once.
    marks = each.where(F.col("stays").isNull() | (F.col("equal") > 1))
    marks = staged(marks.select(F.col("row").alias("own_row"), F.coalesce("stays", F.lit(False)).alias("stays")), "jaccard-marks")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), row_key().alias("row"))
    found = whole.join(broadcast_if_small(marks, text_cols=("own_row",)), F.col("row") == F.col("own_row"), "left")
    out = found.where("own_row is null").select("whole.*")
    if marks.where("stays").isEmpty():
        return out
    return out.unionByName(found.where("stays").dropDuplicates(["row"]).select("whole.*"))
