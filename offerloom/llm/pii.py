"""Personal data: fixed patterns, and identifiers found by bootstrapped contexts.

Fixed patterns give the base spans. They are the seeds: the words around them are lexical
patterns, and every other token that looks like an identifier is an instance that the
same patterns may hold. Spark scores the graph of patterns and instances round by
round: a pattern's confidence is the share of its instances that are known to be of one
kind, an instance is accepted when a pattern of enough support and confidence holds it,
and accepted instances count as known in the next round. Instances travel as hashes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import staged
from offerloom.llm.encode import slices
from offerloom.operators.sizing import broadcast_if_small

#: The kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_EMAIL_AT = re.compile("@" + _DOMAIN)
_LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
# A match takes whole runs of digits, so none starts inside a run: no run is read twice from within.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_SIGN = re.compile(r"[0-9@]")
_EDGE = " \t\r\n\f\v\"'<>()[]{}|,;=:"

SUPPORT = 3
CONFIDENCE = 0.8
#: A bound that only an endless run reaches; rounds end when one accepts nothing.
MOST_ROUNDS = 1000


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        n = int(digit) * (1 + place % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their sign: the run of name characters before it."""
    at, floor = text.find("@"), 0
    while at >= 0:
        begin = max(floor, at - 64)
        name = _LOCAL_TAIL.search(text, begin, at)
        while name and name.start() == begin > floor:
            begin = max(floor, begin - 4096)
            name = _LOCAL_TAIL.search(text, begin, at)
        whole = _EMAIL_AT.match(text, at) if name else None
        if whole:
            yield name.start(), whole.end()
            floor = whole.end()
        at = text.find("@", max(at + 1, floor))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` sorted; kinds as numbers in ``KINDS``."""
    found = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = "".join(_DIGITS.findall(m.group()))
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.findall(m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def _instance(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.lower().encode(), digest_size=8).digest(), "little", signed=True)


def _word(token: str) -> str:
    return token.strip(".,;!?\"'()").lower()[:32]


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span: the word before, two before, both sides.

    A span without a word before has the word after it as its pattern.
    """
    left = [_word(w) for w in text[max(0, start - 80) : start].split()[-2:]]
    right = [_word(w) for w in text[end : end + 60].split()[:1]]
    if not left:
        return [f"* {w}" for w in right]
    found = [f"{left[-1]} *"]
    if len(left) == 2:
        found.append(f"{left[0]} {left[1]} *")
    if right:
        found.append(f"{left[-1]} * {right[0]}")
    return found


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Base spans, and other tokens with two digits or a sign and five characters or more."""
    out, spans = [], sorted((a, b) for a, _, b in base)
    for start, kind, end in base:
        out.append((start, end, kind, text[start:end]))
    floor, at = 0, 0
    for m in _SIGN.finditer(text):
        if m.start() < floor:
            continue
        start, end = m.start(), m.end()
        while start > floor and text[start - 1] not in _EDGE and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and text[end] not in _EDGE and not text[end].isspace():
            end += 1
        floor = end
        while end > start and text[end - 1] in ".!?":
            end -= 1
        while at < len(spans) and spans[at][1] <= start:
            at += 1
        token = text[start:end]
        if at < len(spans) and spans[at][0] < end or len(token) < 5:
            continue
        if "@" in token or len(_DIGITS.findall(token)) >= 2:
            out.append((start, end, None, token))
    return [
        {"start": a, "end": b, "kind": kind, "instance": _instance(token), "patterns": contexts(text, a, b)}
        for a, b, kind, token in out
    ]


_MENTIONS = "array<struct<start:int,end:int,kind:int,instance:long,patterns:array<string>>>"
_ARROW_MENTIONS = pa.list_(
    pa.struct(
        [("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("instance", pa.int64()),
         ("patterns", pa.list_(pa.string()))]
    )
)


def find_mentions(docs: DataFrame) -> DataFrame:
    """``(doc_id, mentions)`` of every row; a null text has none."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = []
                for text in part.column("text").to_pylist():
                    found.append(mentions(text, base_spans(text)) if text and _SIGN.search(text) else [])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(found, _ARROW_MENTIONS)], names=["doc_id", "mentions"]
                )

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return source.mapInArrow(find, f"doc_id long, mentions {_MENTIONS}")


def bootstrap(graph: DataFrame) -> DataFrame:
    """``(instance, kind)`` accepted from ``graph`` with pattern, instance and base kind.

    Each round is written out, so that it starts from a table. A pattern of unusual
    length or frequency needs no special care: all steps combine before they shuffle.
    """
    edges = staged(graph.select("pattern", "instance").distinct(), "pii-edges")
    seeds = graph.where("kind is not null").groupBy("instance").agg(F.min("kind").alias("kind"))
    known = staged(seeds.withColumn("base", F.lit(True)), "pii-known")
    for _ in range(MOST_ROUNDS):
        joined = edges.join(known, "instance", "left")
        totals = joined.groupBy("pattern").agg(
            F.count("*").alias("held"), *[F.count_if(F.col("kind") == k).alias(f"of_{k}") for k in range(len(KINDS))]
        )
        best = F.greatest(*[F.struct(F.col(f"of_{k}").alias("n"), F.lit(k).alias("kind")) for k in range(len(KINDS))])
        sure = totals.withColumn("best", best).where(
            (F.col("best.n") >= SUPPORT) & (F.col("best.n") >= CONFIDENCE * F.col("held")) & (F.col("best.n") < F.col("held"))
        )
        sure = sure.select("pattern", (F.col("best.n") / F.col("held")).alias("sure"), F.col("best.kind").alias("found"))
        new = joined.where("kind is null").join(broadcast_if_small(sure, text_cols=("pattern",)), "pattern")
        new = new.groupBy("instance").agg(F.max(F.struct("sure", F.negate("found").alias("n"))).alias("m"))
        new = staged(new.select("instance", F.negate("m.n").cast("int").alias("kind"), F.lit(False).alias("base")), "pii-new")
        if new.isEmpty():
            return known.where("not base").select("instance", F.col("kind").alias("found"))
        known = staged(known.unionByName(new), "pii-known")
    raise RuntimeError(f"identifiers are still being accepted after {MOST_ROUNDS} rounds")


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts and spans of every row, base spans first hashed and then all listed.

    Null and empty texts have no spans. Repeated rows are rows of their own. Other columns
    are ignored.
    """
    rows = find_mentions(docs).withColumn("uid", F.monotonically_increasing_id())
    rows = staged(rows, "pii-mentions")
    each = rows.select("uid", F.explode("mentions").alias("m")).select("uid", "m.*")
    graph = each.select(F.explode("patterns").alias("pattern"), "instance", "kind")
    accepted = bootstrap(graph)
    others = each.where("kind is null").select("uid", "start", "end", "instance")
    added = others.join(broadcast_if_small(accepted), "instance").groupBy("uid").agg(
        F.collect_list(F.struct("start", F.col("found").alias("kind"), "end")).alias("added")
    )
    base = F.transform(
        F.filter("mentions", lambda m: m["kind"].isNotNull()),
        lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")),
    )
    names = F.array(*map(F.lit, KINDS))

    def listed(spans):
        return F.array_join(
            F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
        )

    full = rows.withColumn("base", base).join(added, "uid", "left")
    counts = [
        F.size(F.array_remove(F.transform("base", lambda s: s["kind"] == k), False)).cast("long").alias(f"n_{kind}")
        for k, kind in enumerate(KINDS)
    ]
    everything = F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>")))
    return full.select(
        "doc_id", *counts,
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(everything).alias("spans"),
    )
