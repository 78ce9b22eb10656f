"""DNS records as a source of Spark whose position is the id of the last record taken.

Whatever polls a resolver leaves pages in a folder: JSON lines, one file per page, named
by the ids it may hold, ``<lowest>-<highest>.json``. What is new is planned from the names:
pages at or below the cursor are never opened, and each task reads pages of about
``ids_per_task`` ids. Lines are parsed by Spark, not by the source.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from netlens.functions.scalars import ts_lit
from netlens.schema import DNS_RECORD_SCHEMA
from netlens.sources.dns_queries import FIRST_RUN_MINUTES

FORMAT = "record_pages"
PAGE = re.compile(r"(\d+)-(\d+)\.json")
IDS_PER_TASK = 1_000_000
LINES_PER_BATCH = 50_000
# Of each line: the ids wanted from its page, the oldest time wanted, and whether the page
# is read for the first time.
COLUMNS = "after bigint, upto bigint, since double, first boolean, raw_log string"


@dataclass(frozen=True, order=True)
class Page:
    low: int
    high: int
    path: str


@dataclass
class IdRange(InputPartition):
    """Pages of one task, and the ids wanted: above ``after``, up to ``upto``."""

    after: int
    upto: int
    since: float | None
    pages: tuple[Page, ...]


def ranges(pages: list[Page], after: int, upto: int, since: float | None, ids_per_task: int) -> list[IdRange]:
    """Pages that may hold wanted ids, in runs of about ``ids_per_task`` ids."""
    out: list[IdRange] = []
    run: list[Page] = []
    width = 0
    for page in sorted(pages):
        if page.high <= after or page.low > upto:
            continue
        run.append(page)
        width += min(page.high, upto) - max(page.low, after + 1) + 1
        if width >= ids_per_task:
            out.append(IdRange(after, upto, since, tuple(run)))
            run, width = [], 0
    return out + ([IdRange(after, upto, since, tuple(run))] if run else [])


class _Pages:
    """What batch and stream readers share."""

    def __init__(self, options):
        self.path = options["path"]
        self.ids_per_task = int(options.get("ids_per_task", IDS_PER_TASK))

    def files(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def pages(self) -> list[Page]:
        files, folder = self.files()
        found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        named = ((PAGE.fullmatch(f.base_name), f.path) for f in found if f.is_file)
        return [Page(int(m[1]), int(m[2]), path) for m, path in named if m]

    def read(self, partition: IdRange) -> Iterator[pa.RecordBatch]:
        files, _ = self.files()
        schema = pa.schema([("after", pa.int64()), ("upto", pa.int64()), ("since", pa.float64()), ("first", pa.bool_()), ("raw_log", pa.string())])
        for page in partition.pages:
            with files.open_input_stream(page.path) as stream:
                for lines in _lines(stream):
                    n = len(lines)
                    columns = [[partition.after] * n, [partition.upto] * n, [partition.since] * n, [partition.after < page.low] * n, lines]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _lines(stream) -> Iterator[list[str]]:
    """Lines of a file in lists of bounded length."""
    rest, lines = b"", []
    while block := stream.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        lines += whole
        if len(lines) >= LINES_PER_BATCH:
            yield [x.decode("utf-8", "replace") for x in lines]
            lines = []
    lines.append(rest)
    yield [x.decode("utf-8", "replace") for x in lines if x]


class PageReader(_Pages, DataSourceReader):
    def __init__(self, options):
        super().__init__(options)
        self.cursor = int(options.get("cursor", 0))
        self.since = float(options["since"]) if "since" in options else None

    def partitions(self) -> list[IdRange]:
        pages = self.pages()
        upto = max((p.high for p in pages), default=self.cursor)
        return ranges(pages, self.cursor, upto, self.since, self.ids_per_task) or [IdRange(self.cursor, upto, None, ())]


class PageStreamReader(_Pages, DataSourceStreamReader):
    """Offsets are ``{"id": n, "since": t}``: the last id taken, and for the very first batch
    the oldest time wanted."""

    def __init__(self, options):
        super().__init__(options)
        self.since = float(options["since"]) if "since" in options else None

    def initialOffset(self) -> dict:
        """Before the oldest page that reaches into the time wanted: pages are looked at from
        the newest one back, to the first that is older as a whole."""
        if self.since is None:
            return {"id": 0, "since": None}
        for page in sorted(self.pages(), reverse=True):
            if self._newest(page) < self.since:
                return {"id": page.high, "since": self.since}
        return {"id": 0, "since": self.since}

    def latestOffset(self) -> dict:
        return {"id": max((p.high for p in self.pages()), default=0), "since": None}

    def partitions(self, start: dict, end: dict) -> list[IdRange]:
        return ranges(self.pages(), start["id"], end["id"], start["since"], self.ids_per_task)

    def _newest(self, page: Page) -> float:
        files, _ = self.files()
        newest = float("-inf")
        with files.open_input_stream(page.path) as stream:
            for lines in _lines(stream):
                for line in lines:
                    try:
                        newest = max(newest, float(json.loads(line)["time"]))
                    except (ValueError, KeyError, TypeError):
                        continue
        return newest


class RecordPages(DataSource):
    """Options: ``path``; ``since`` (seconds, first run only), ``ids_per_task``, and for
    batches ``cursor``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)

    def streamReader(self, schema) -> PageStreamReader:
        return PageStreamReader(self.options)


def read_record_pages(
    spark: SparkSession, path: str, now: str | datetime, cursor: int | None = None, ids_per_task: int = IDS_PER_TASK
) -> DataFrame:
    """Records beyond the cursor with their text as ``raw_log``, as ``read_dns_records`` gives
    them. Without ``cursor`` a stream, whose checkpoint holds it; the first run (cursor 0)
    looks back five minutes. A line that is no record comes with the first reading of its
    page. A page that grows after it was read is not read again: pages are written whole.
    """
    spark.dataSource.register(RecordPages)
    start = spark.range(1).select(F.floor(ts_lit(now).cast("double") - FIRST_RUN_MINUTES * 60)).first()[0]  # one number
    reader = (spark.readStream if cursor is None else spark.read).format(FORMAT).option("path", path).option("ids_per_task", ids_per_task)
    if not cursor:
        reader = reader.option("since", start)
    lines = (reader if cursor is None else reader.option("cursor", cursor)).load()
    parsed = lines.withColumn("r", F.from_json("raw_log", DNS_RECORD_SCHEMA))
    record = F.col("r.id").isNotNull()
    wanted = (F.col("r.id") > F.col("after")) & (F.col("r.id") <= F.col("upto")) & (F.col("since").isNull() | (F.col("r.time") >= F.col("since")))
    return parsed.where(F.when(record, F.coalesce(wanted, F.lit(False))).otherwise(F.col("first"))).select("r.*", "raw_log")
