"""What a run leaves: papers with events, reports and statistics, published all at once.

A publication is a folder ``<name>_<stamp>`` under the output folder, with one table in each of
its folders, written by Spark's committer.  Only when all are there does the driver create
the file ``_published`` in it, which names them; readers take the latest stamp that has one.  So
a task or a driver that fails leaves what was published before as it was, and nobody sees
papers without their events.  All goes through Hadoop's file systems; creating one file is the only step
that has to be atomic, which it is on object stores too.  One writer at a time for each name.
"""

from __future__ import annotations

import sys
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import providers

_MARK = "_published"


class _Files:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.folder = folder

    def names(self, below: str = "") -> list[str]:
        at = self.path(f"{self.folder}/{below}" if below else self.folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def there(self, name: str) -> bool:
        return self.fs.exists(self.path(f"{self.folder}/{name}"))

    def create(self, name: str, text: str) -> None:
        out = self.fs.create(self.path(f"{self.folder}/{name}"), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, name: str) -> str:
        found = self.fs.open(self.path(f"{self.folder}/{name}"))
        try:
            return bytes(found.readAllBytes()).decode()
        finally:
            found.close()

    def drop(self, name: str) -> None:
        self.fs.delete(self.path(f"{self.folder}/{name}"), True)


def stamped(name: str, at: datetime | None = None) -> str:
    """``name_YYYYmmdd_HHMMSS_micros``; what one run leaves shares a time."""
    return f"{name}_{(at or datetime.now()).strftime('%Y%m%d_%H%M%S_%f')}"


def publications(spark: SparkSession, folder: str, name: str) -> list[str]:
    """The published folders of a name, oldest first."""
    files = _Files(spark, folder)
    return [x for x in files.names() if x.startswith(f"{name}_") and x[len(name) + 1 :].replace("_", "").isdigit() and files.there(f"{x}/{_MARK}")]


def publish(tables: dict[str, DataFrame], folder: str, name: str, at: datetime | None = None, keep: int = 2) -> str:
    """Publishes the tables together as JSON lines and returns their folder's name; older publications beyond ``keep`` go.

    Fails with the error of the write, what it left removed; a stamp that is taken is an error.
    """
    spark = next(iter(tables.values())).sparkSession
    files, mine = _Files(spark, folder), stamped(name, at)
    if files.there(mine):
        raise FileExistsError(mine)
    try:
        for part, rows in tables.items():
            rows.write.json(f"{folder}/{mine}/{part}")
        files.create(f"{mine}/{_MARK}", "\n".join(f"{part}\t{rows.schema.json()}" for part, rows in tables.items()))
    except Exception:
        files.drop(mine)
        raise
    for old in publications(spark, folder, name)[:-keep]:
        files.drop(old)
    return mine


def published(spark: SparkSession, folder: str, name: str, part: str) -> DataFrame:
    """A table of the latest publication, with the columns it was written with."""
    found = publications(spark, folder, name)
    if not found:
        raise FileNotFoundError(f"{name} isn't published in the folder")
    at = f"{folder}/{found[-1]}"
    lines = dict(line.split("\t", 1) for line in _Files(spark, at).read(_MARK).split("\n"))  # a line for each table
    kind = spark._jvm.org.apache.spark.sql.types.DataType.fromJson(lines[part]).toDDL()
    return spark.read.schema(kind).json(f"{at}/{part}")


def saved(what: str, write, *args, **options) -> str | None:
    """The name that ``write`` returns, or none if it fails: a warning with the error's class alone goes to stderr, and the run goes on."""
    try:
        return write(*args, **options)
    except Exception as error:  # noqa: BLE001 - a run doesn't end because its output can't be saved
        print(f"Failed to save {what}: {type(error).__name__} (details omitted)", file=sys.stderr)
        return None


def write_report(sections: DataFrame, folder: str, title: str, at: datetime | None = None) -> str:
    """One JSON line for each section, and the title in each, in order of section_index."""
    named = sections.withColumn("report_title", F.lit(" ".join(title.split()) or "Untitled review"))
    return publish({"sections": named.repartitionByRange("section_index").sortWithinPartitions("section_index")}, folder, "report", at)


def write_papers(papers: DataFrame, events: DataFrame, folder: str, at: datetime | None = None) -> str:
    """Papers with sanitised URLs, and the events, together."""
    return publish({"papers": providers.safe_paper(papers), "events": events}, folder, "papers", at)


def write_stats(stats: DataFrame, folder: str, at: datetime | None = None) -> str:
    """A one-row table of counters."""
    return publish({"stats": stats.coalesce(1)}, folder, "stats", at)
