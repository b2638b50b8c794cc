"""Tables whose versions are lists of Parquet folders, published by one rename.

A commit writes its rows to new folders first and then publishes a manifest: a JSON file that
names the folder of every entry. What is not published is not read, so a run that breaks off
leaves the last version as it was. An entry that is committed again replaces itself, so a
repeated run adds nothing. Two writers cannot publish the same version: the rename of the
second is refused, and it starts again from the first one's version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from typing import Any, NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from offerloom.sources.listing import file_context, names_in
from offerloom.sources.records import empty

_MANIFESTS, _DATA = "_versions", "data"
#: Attempts to publish while others publish too.
ATTEMPTS = 20


class Version(NamedTuple):
    """``entries`` maps names to folders, ``notes`` holds what a writer remembers."""

    number: int
    entries: dict[str, str]
    notes: dict[str, Any]


def version_numbers(spark: SparkSession, root: str) -> list[int]:
    """Published versions, oldest first: a listing of one folder."""
    found = names_in(spark, f"{root}/{_MANIFESTS}")
    return sorted(int(n.removesuffix(".json")) for n in found if n.endswith(".json") and n[0].isdigit())


def read_manifest(spark: SparkSession, root: str, number: int | None = None) -> Version:
    """A version, the newest if no number is given; version 0 is empty."""
    if number is None:
        number = max(version_numbers(spark, root), default=0)
    if number == 0:
        return Version(0, {}, {})
    context, where = file_context(spark, f"{root}/{_MANIFESTS}/{number:012d}.json")
    stream = context.open(where)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    held = json.loads(text)
    return Version(number, held["entries"], held["notes"])


def _publish(spark: SparkSession, root: str, version: Version) -> bool:
    """Whether this version is now the one of its number; false if another took the number."""
    fs = spark._jvm.org.apache.hadoop.fs
    target = f"{root}/{_MANIFESTS}/{version.number:012d}.json"
    context, draft = file_context(spark, f"{root}/{_MANIFESTS}/_draft-{uuid.uuid4().hex}")
    system = draft.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = system.create(draft, False)
    stream.write(bytearray(json.dumps({"entries": version.entries, "notes": version.notes}).encode()))
    stream.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    try:
        context.rename(draft, fs.Path(target), options)
        return True
    except Py4JJavaError as error:
        system.delete(draft, False)
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise


def commit(
    spark: SparkSession,
    root: str,
    put: dict[str, DataFrame],
    drop: Sequence[str] = (),
    notes: dict[str, Any] | None = None,
    unless: Callable[[Version], bool] | None = None,
) -> int:
    """Write the tables of ``put`` and publish them as entries of a new version; its number.

    Entries of the same names are replaced, those in ``drop`` leave, others stay. ``notes`` are
    added to those of the version before. Where ``unless`` holds for the newest version, nothing
    is published and its number is returned.
    """
    written = {}
    if unless is not None and unless(found := read_manifest(spark, root)):
        return found.number
    for name, df in put.items():
        folder = f"{_DATA}/{uuid.uuid4().hex}"
        df.write.parquet(f"{root}/{folder}")
        written[name] = folder
    for _ in range(ATTEMPTS):
        last = read_manifest(spark, root)
        if unless is not None and unless(last):
            return last.number
        kept = {n: f for n, f in last.entries.items() if n not in drop}
        version = Version(last.number + 1, {**kept, **written}, {**last.notes, **(notes or {})})
        if _publish(spark, root, version):
            return version.number
    raise RuntimeError(f"{ATTEMPTS} other versions of {root} were published meanwhile")


def append_records(df: DataFrame, root: str, batch: str) -> int:
    """Add the rows of one batch; a batch that is appended again replaces itself."""
    return commit(df.sparkSession, root, {batch: df})


def read_entries(
    spark: SparkSession, root: str, schema: T.StructType, prefix: str = "", version: Version | None = None
) -> DataFrame:
    """Rows of all entries whose names begin with ``prefix``, of the newest version or a pinned one."""
    version = read_manifest(spark, root) if version is None else version
    folders = [f"{root}/{f}" for n, f in sorted(version.entries.items()) if n.startswith(prefix)]
    return spark.read.schema(schema).parquet(*folders) if folders else empty(spark, schema)


def clean_up(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete manifests but the newest ``keep``, and folders that none of those name.

    Folders of commits under way are not named yet: run it when none is.
    """
    numbers = version_numbers(spark, root)
    held = {f for n in numbers[-keep:] for f in read_manifest(spark, root, n).entries.values()}
    gone = [f"{_DATA}/{name}" for name in names_in(spark, f"{root}/{_DATA}") if f"{_DATA}/{name}" not in held]
    for path in [f"{_MANIFESTS}/{n:012d}.json" for n in numbers[:-keep]] + gone:
        context, where = file_context(spark, f"{root}/{path}")
        context.delete(where, True)
    return gone
