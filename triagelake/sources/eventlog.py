"""A log of numbered entries in Parquet files, read as a stream from a given id on.

    spark.dataSource.register(EventLog)
    spark.readStream.format("event_log").option("path", folder).option("after", "41").load()

The offset is the last id read, so a query starts behind any id and resumes at its
own. Ids grow with time: an entry whose id is below one already read is not seen.
Only the footers of new files are read to learn what there is; the entries are read
by tasks, a row group each, and row groups outside the wanted ids are not opened.
"""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema

Ranges = list[tuple[int, int, int]]


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if urlparse(path).scheme else (pafs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    fs, root = _open(path)
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted(f.path for f in found if f.is_file and f.base_name.endswith(".parquet") and f.base_name[0] not in "._")


def _ranges(path: str, file: str, id_col: str) -> Ranges:
    """(row group, smallest id, largest id) of a file, from its footer; empty row groups are left out."""
    fs, _ = _open(path)
    footer = pq.ParquetFile(file, filesystem=fs)
    at = footer.schema_arrow.get_field_index(id_col)
    out = []
    for g in range(footer.num_row_groups):
        stats = footer.metadata.row_group(g).column(at).statistics
        if stats is not None and stats.has_min_max:
            out.append((g, stats.min, stats.max))
        elif footer.metadata.row_group(g).num_rows:
            ids = pc.min_max(footer.read_row_group(g, [id_col]).column(0)).as_py()
            if ids["max"] is not None:
                out.append((g, ids["min"], ids["max"]))
    return out


@dataclass
class RowGroup(InputPartition):
    file: str
    group: int
    after: int
    upto: int


class EventLogReader(DataSourceStreamReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.id_col = options["path"], options.get("id", "event_id")
        self.after, self.columns = int(options.get("after", -1)), columns
        self.known: dict[str, Ranges] = {}

    def initialOffset(self) -> dict:
        return {"id": self.after}

    def latestOffset(self) -> dict:
        for file in _files(self.path):
            if file not in self.known:
                self.known[file] = _ranges(self.path, file, self.id_col)
        return {"id": max([self.after, *(high for ranges in self.known.values() for _, _, high in ranges)])}

    def partitions(self, start: dict, end: dict) -> list[RowGroup]:
        if not self.known:                                  # a batch planned again after a restart
            self.latestOffset()
        return [RowGroup(file, g, start["id"], end["id"]) for file, ranges in self.known.items()
                for g, low, high in ranges if high > start["id"] and low <= end["id"]]

    def read(self, part: RowGroup):
        fs, _ = _open(self.path)
        for b in pq.ParquetFile(part.file, filesystem=fs).iter_batches(row_groups=[part.group], columns=self.columns):
            ids = b.column(b.schema.get_field_index(self.id_col))
            wanted = b.filter(pc.and_(pc.greater(ids, part.after), pc.less_equal(ids, part.upto)))
            if wanted.num_rows:
                yield wanted.select(self.columns)

    def commit(self, end: dict) -> None:
        """Nothing is held for a batch that is done."""


class EventLog(DataSource):
    """Options: path; id (the column of the ids, event_id); after (the id to start behind, -1: all)."""

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self):
        path = self.options["path"]
        files = _files(path)
        if not files:
            raise FileNotFoundError(f"no entries in {path}: name their schema")
        return from_arrow_schema(pq.read_schema(files[0], filesystem=_open(path)[0]))

    def streamReader(self, schema) -> EventLogReader:
        return EventLogReader(self.options, schema.fieldNames())
