"""Periodic snapshot objects: choosing the newest ones and reading them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.schemas import SNAPSHOT_ENVELOPE, SPINE
from tallyhouse.sources.store import Files

#: Layout of snapshot object paths: account, region, year, month, day.
SNAPSHOT_PATH = (
    r"/AWSLogs/([^/]+)/Config/([^/]+)/(\d+)/(\d+)/(\d+)/ConfigSnapshot/[^/]+$"
)


def latest_snapshots(paths: DataFrame, path: str = "path") -> DataFrame:
    """Newest snapshot object of every account and region.

    Day directories without an object never appear in a listing, so the newest
    day that holds one wins. Dates compare as numbers, so unpadded months and
    days order correctly. If a day holds several objects the last by name is
    taken and ``objectsThatDay`` tells how many there were.
    """
    parts = {
        name: F.regexp_extract(path, SNAPSHOT_PATH, i)
        for i, name in enumerate(["accountId", "awsRegion", "y", "m", "d"], start=1)
    }
    day = F.struct(*[parts[p].try_cast("int").alias(p) for p in ("y", "m", "d")])
    per_day = (
        paths.select(
            F.col(path).alias("path"),
            parts["accountId"].alias("accountId"),
            parts["awsRegion"].alias("awsRegion"),
            day.alias("day"),
        )
        .filter(F.col("accountId") != "")
        .groupBy("accountId", "awsRegion", "day")
        .agg(F.max("path").alias("path"), F.count("*").alias("objectsThatDay"))
    )
    newest = F.max_by(F.struct("path", "day", "objectsThatDay"), F.col("day"))
    return (
        per_day.groupBy("accountId", "awsRegion")
        .agg(newest.alias("newest"))
        .select("accountId", "awsRegion", "newest.*")
    )


def list_snapshot_paths(spark: SparkSession, root: str) -> DataFrame:
    """Paths below ``root``; only names are listed, no content is read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path")
    )


def newest_snapshot_paths(
    spark: SparkSession, root: str, files: Files | None = None, threads: int = 32
) -> list[str]:
    """Path of the newest snapshot of every account and region below ``root``.

    The same choice as :func:`latest_snapshots` without listing the history: of
    each account and region the years, months and days are descended newest
    first, and the first day that holds an object ends the walk. What the driver
    holds is one path for each account and region.
    """
    files = files or Files(spark)
    regions = [
        f"{logs}/{account}/Config/{region}"
        for logs in _log_folders(files, root.rstrip("/"))
        for account in files.children(logs)
        for region in files.children(f"{logs}/{account}/Config")
    ]
    if not regions:
        return []
    with ThreadPoolExecutor(max_workers=min(threads, len(regions))) as pool:
        found = pool.map(lambda folder: _newest_below(files, folder, 3), regions)
        return [path for path in found if path is not None]


def _log_folders(files: Files, folder: str) -> list[str]:
    """Folders named ``AWSLogs`` at or below ``folder``; they are not searched themselves."""
    if folder.rpartition("/")[2] == "AWSLogs":
        return [folder]
    names = files.folders(folder)
    if "AWSLogs" in names:
        return [f"{folder}/AWSLogs"]
    return [found for name in names for found in _log_folders(files, f"{folder}/{name}")]


def _newest_below(files: Files, folder: str, levels: int) -> str | None:
    if not levels:
        names = files.children(f"{folder}/ConfigSnapshot")
        return f"{folder}/ConfigSnapshot/{names[-1]}" if names else None
    dated = [n for n in files.children(folder) if re.fullmatch(r"[0-9]+", n)]
    for name in sorted(dated, key=lambda n: (int(n), n), reverse=True):
        path = _newest_below(files, f"{folder}/{name}", levels - 1)
        if path is not None:
            return path
    return None


def read_snapshots(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Spine rows of snapshot envelopes.

    Tags arrive as an object here, so they map straight onto the spine column.
    An envelope without its item array fails the load: taking it for an empty one
    would clear an account. A gzip-compressed document cannot be split, so each is
    one task, but it streams: a task holds one item at a time, however long the
    document is. Other documents are read whole.
    """
    packed = [p for p in paths if p.endswith(".gz")]
    plain = [p for p in paths if not p.endswith(".gz")]
    if not packed:
        return _read_envelopes(spark, plain) if plain else spark.createDataFrame([], SPINE)
    items = _read_streamed(spark, packed)
    return items.unionByName(_read_envelopes(spark, plain)) if plain else items


def _read_envelopes(spark: SparkSession, paths: list[str]) -> DataFrame:
    envelopes = (
        spark.read.schema(SNAPSHOT_ENVELOPE)
        .option("multiLine", "true")
        .option("mode", "FAILFAST")
        .json(paths)
    )
    return envelopes.select(F.inline(required_items(F.col("configurationItems"))))


def _read_streamed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Items cut out of the documents, which arrive in pieces that end where an
    object may end; Spark parses the items."""
    pieces = (
        spark.read.option("lineSep", "}")
        .text(paths)
        .select(F.col("_metadata.file_path").alias("path"), "value")
    )
    parsed = F.from_json("item", SPINE, {"mode": "FAILFAST"})
    return pieces.mapInArrow(_cut_items, "item string").select(parsed.alias("row")).select("row.*")


def _cut_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one document stand together and in order, as its file is one task."""
    path, splitter = None, None
    for batch in batches:
        items = []
        for here, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if here != path:
                if splitter is not None:
                    splitter.close()
                path, splitter = here, ItemSplitter()
            item = splitter.feed(piece)
            if item is not None:
                items.append(item)
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.string())], ["item"])
    if splitter is not None:
        splitter.close()


class ItemSplitter:
    """Cuts the items out of a snapshot document that was split at each ``}``.

    An object can only end where a piece does, so a piece completes at most one
    item. Braces inside of strings do not count; a string may go on over several
    pieces. Held are the parts of the item that is open.
    """

    ITEMS = "configurationItems"
    _STRING = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"', re.DOTALL)
    _STRING_END = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.DOTALL)
    _TOKEN = re.compile(rf'{_STRING.pattern}|[{{}}\[\]"]', re.DOTALL)

    def __init__(self):
        self.depth = 0
        self.seen = False  # the item array has been there
        self.done = False  # the document has ended
        self._inside = False  # in the item array
        self._open = False  # in a string
        self._last = ""  # the last string between the envelope's braces
        self._parts: list[str] = []

    def feed(self, piece: str) -> str | None:
        """The item that ends with this piece, if one does."""
        if self.done:
            if piece.strip():
                raise ValueError("malformed json")
            return None
        piece += "}"
        if not self._inside:
            at = self._envelope(piece)
            if at is None:
                return None
            piece = piece[at:]
        return self._item(piece)

    def close(self) -> None:
        if not (self.seen and self.done):
            raise ValueError("malformed json")

    def _envelope(self, piece: str) -> int | None:
        """Read what is around the items; where they begin, if they do."""
        at = 0
        if self._open:
            end = self._STRING_END.match(piece)
            if end is None:
                return None
            self._open, at = False, end.end()
        for token in self._TOKEN.finditer(piece, at):
            text = token.group()
            if text == '"':
                self._open = True
                return None
            if text in "{[":
                self.depth += 1
                if text == "[" and self.depth == 2 and self._last == self.ITEMS:
                    self.seen = self._inside = True
                    return token.end()
            elif text in "}]":
                self.depth -= 1
                if self.depth <= 0:
                    self.done = True
            elif self.depth == 1:
                self._last = text[1:-1]
        return None

    def _item(self, piece: str) -> str | None:
        if not self._parts:
            rest = piece.lstrip(" \t\r\n,")
            if rest.startswith("]"):
                self._inside, self._last = False, ""
                self.depth -= 1
                self._envelope(rest[1:])
                return None
            if not rest.startswith("{"):
                raise ValueError("malformed json")
            piece = rest
        self._parts.append(piece)
        at = 0
        if self._open:
            end = self._STRING_END.match(piece)
            if end is None:
                return None
            self._open, at = False, end.end()
        bare = self._STRING.sub("", piece[at:])
        if '"' in bare:
            self._open = True
            bare = bare[: bare.index('"')]
        self.depth += bare.count("{") + bare.count("[") - bare.count("}") - bare.count("]")
        if self.depth > 2:
            return None
        if self.depth < 2:
            raise ValueError("malformed json")
        item, self._parts = "".join(self._parts), []
        return item


def required_items(items: Column) -> Column:
    return F.when(items.isNull(), F.raise_error(F.lit("malformed json"))).otherwise(
        items
    )


def read_latest_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """Spine rows of the newest snapshot of every account and region."""
    return read_snapshots(spark, newest_snapshot_paths(spark, root))
