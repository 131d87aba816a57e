"""Spreadsheet files as a data source: planned partitions of sheets and rows to read, files written by the executors."""

from __future__ import annotations

import io
import itertools
import os
import re
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from . import workbook

FORMAT = "finlattice_spreadsheet"
CELLS = "path string, sheet string, row_no int, col_no int, value string"
#: A sheet of more XML than this is read by several tasks, a range of rows each.
SPLIT_BYTES = 8 << 20
#: Of more files than FEW the small ones are read whole, many by a task: of PACKED bytes together, where opening one counts as OPEN more.
FEW, SMALL_BYTES, PACKED, OPEN = 64, 512 << 10, 32 << 20, 64 << 10
#: Where a folder's files lie if they were dealt into folders: the driver knows these by name, tasks list what is in them.
DEALT = "dealt"
#: A task's files wait for commit in folders of so many, one of which is listed at a time.
LISTED = 1000


def store_of(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) else os.path.abspath(path))


def dealt(store, root: str) -> list[str]:
    """The folders that files of `root` were dealt into."""
    from pyarrow import fs

    found = store.get_file_info(fs.FileSelector(f"{root.rstrip('/')}/{DEALT}", allow_not_found=True))
    return sorted(f.path for f in found if f.type == fs.FileType.Directory)


@dataclass
class Rows(InputPartition):
    path: str
    sheet: str
    part: str
    first: int
    last: int | None

    def __post_init__(self):
        super().__init__((self.path, self.sheet, self.first))


@dataclass
class Files(InputPartition):
    """Small spreadsheets of the folder, by name."""

    names: list

    def __post_init__(self):
        super().__init__(self.names[0])


@dataclass
class Dealt(InputPartition):
    """A folder that spreadsheets were dealt into."""

    folder: str

    def __post_init__(self):
        super().__init__(self.folder)


class CellReader(DataSourceReader):
    """Cells of the spreadsheets of a folder or of one. Filters on sheet and row_no choose partitions, one on col_no cells."""

    def __init__(self, options):
        self.path, self.split = options["path"], int(options.get("splitBytes", SPLIT_BYTES))
        self.sheets: set | None = None
        self.columns: set | None = None
        self.first, self.last = 1, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, (EqualTo, In)) and name in ("sheet", "col_no"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                if name == "sheet":
                    self.sheets = values if self.sheets is None else self.sheets & values
                else:
                    self.columns = values if self.columns is None else self.columns & values
            elif name == "row_no" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    last = f.value - isinstance(f, LessThan)
                    self.last = last if self.last is None else min(self.last, last)
            else:
                yield f

    def partitions(self) -> list[Rows | Files | Dealt]:
        from pyarrow import fs

        store, path = store_of(self.path)
        info = store.get_file_info(path)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(path)) if info.type != fs.FileType.NotFound else []
        found = sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith(".xlsx"))
        small = self.split // 16 if self.split < SPLIT_BYTES else SMALL_BYTES
        packed = [f for f in found if f[1] <= small] if len(found) > FEW else []
        out, names, size = [] if info.is_file else [Dealt(f) for f in dealt(store, path)], [], 0
        for f, n in packed:
            if names and size + n + OPEN > PACKED:
                out.append(Files(names))
                names, size = [], 0
            names.append(f.rsplit("/", 1)[1])
            size += n + OPEN
        if names:
            out.append(Files(names))
        for f, _ in found if not packed else [f for f in found if f[1] > small]:
            with store.open_input_file(f) as raw, zipfile.ZipFile(raw) as z:  # its directory and list of sheets only
                for sheet, part in workbook.sheets(z):
                    if self.sheets is None or sheet in self.sheets:
                        out += [Rows(f, sheet, part, a, b) for a, b in self.ranges(z, part) if (self.last is None or a <= self.last) and (b is None or b >= self.first)]
        return out

    def ranges(self, z: zipfile.ZipFile, part: str) -> list[tuple[int, int | None]]:
        size = z.getinfo(part).file_size
        if size <= self.split:
            return [(1, None)]
        with z.open(part) as f:
            said = re.search(rb'<dimension ref="[A-Z]+\d+:[A-Z]+(\d+)"', f.read(4096))
        if not said:
            return [(1, None)]
        n = int(said[1])
        step = max(1, -(-n // -(-size // self.split)))
        return [(a, a + step - 1 if a + step <= n else None) for a in range(1, n + 1, step)]

    def read(self, p: Rows | Files | Dealt | None) -> Iterator:
        import pyarrow as pa

        rows = self.cells(p)
        while some := list(itertools.islice(rows, 20_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()))], ["path", "sheet", "row_no", "col_no", "value"])

    def cells(self, p: Rows | Files | Dealt | None) -> Iterator[tuple]:
        if p is None:  # there is no spreadsheet, or none that the filters leave
            return
        store, root = store_of(self.path)
        if isinstance(p, Rows):
            last = min((x for x in (p.last, self.last) if x is not None), default=None)
            with store.open_input_file(p.path) as raw, zipfile.ZipFile(raw) as z:
                yield from self.of_sheet(z, p.path, p.sheet, p.part, max(p.first, self.first), last)
            return
        if isinstance(p, Dealt):
            from pyarrow import fs

            paths = sorted(f.path for f in store.get_file_info(fs.FileSelector(p.folder)) if f.is_file and f.path.endswith(".xlsx"))
        else:
            paths = [f"{root.rstrip('/')}/{name}" for name in p.names]
        for path in paths:
            with store.open_input_file(path) as raw:
                content = raw.read()
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for sheet, part in workbook.sheets(z):
                    if self.sheets is None or sheet in self.sheets:
                        yield from self.of_sheet(z, path, sheet, part, self.first, self.last)

    def of_sheet(self, z: zipfile.ZipFile, path: str, sheet: str, part: str, first: int, last: int | None) -> Iterator[tuple]:
        for row, col, value in workbook.cells_of(z, part, first, last):
            if self.columns is None or col in self.columns:
                yield path, sheet, row, col, value


@dataclass
class Written(WriterCommitMessage):
    folder: str


class FileWriter(DataSourceWriter):
    """Rows (name, content) as files: each task writes to a folder of its own; commit moves the files, a failure leaves none.

    With perFolder, small files are dealt into folders of so many (of PACKED bytes at most), which commit moves whole;
    large ones stay in the folder itself, where readers plan them by sheet and rows.
    """

    def __init__(self, options):
        self.path, self.job, self.per = options["path"], uuid.uuid4().hex, int(options.get("perFolder", 0))
        self.most = self.per or LISTED

    def work(self, root: str) -> str:
        return f"{root.rstrip('/')}/_temporary-{self.job}"

    def write(self, rows: Iterator) -> Written:
        store, root = store_of(self.path)
        own = uuid.uuid4().hex
        folder = f"{self.work(root)}/{own}"
        store.create_dir(folder, recursive=True)
        k, n, size = -1, self.most, 0
        try:
            for r in rows:
                name = os.path.basename(r["name"])
                if not name or r["content"] is None:
                    raise ValueError("a file needs a name and content")
                content, to = bytes(r["content"]), folder
                if not self.per or len(content) <= SMALL_BYTES:
                    if n == self.most or self.per and size + len(content) > PACKED:
                        k, n, size = k + 1, 0, 0
                        store.create_dir(f"{folder}/{own}-{k:06d}")
                    to, n, size = f"{folder}/{own}-{k:06d}", n + 1, size + len(content)
                with store.open_output_stream(f"{to}/{name}") as f:
                    f.write(content)
        except BaseException:
            store.delete_dir(folder)
            raise
        return Written(folder)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        store, root = store_of(self.path)
        root = root.rstrip("/")
        inside = lambda folder, kind: sorted(f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.type == kind)
        with ThreadPoolExecutor(16) as pool:
            for m in filter(None, messages):  # names only, of one folder at a time: no content passes the driver
                folders = inside(m.folder, fs.FileType.Directory)
                if self.per and folders:
                    store.create_dir(f"{root}/{DEALT}", recursive=True)
                    list(pool.map(lambda at: store.move(at, f"{root}/{DEALT}/{at.rsplit('/', 1)[1]}"), folders))
                for folder in [m.folder] if self.per else folders:
                    list(pool.map(lambda at: store.move(at, f"{root}/{at.rsplit('/', 1)[1]}"), inside(folder, fs.FileType.File)))
        self.abort([])

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        store, root = store_of(self.path)
        if store.get_file_info(self.work(root)).type != fs.FileType.NotFound:
            store.delete_dir(self.work(root))


class SpreadsheetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> CellReader:
        return CellReader(self.options)

    def writer(self, schema, overwrite: bool) -> FileWriter:
        if overwrite:
            raise ValueError("spreadsheets are added to a folder; those of the same name are replaced")
        return FileWriter(self.options)


def cells(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """path, sheet, row_no, col_no, value of the cells of a spreadsheet or of a folder's."""
    spark.dataSource.register(SpreadsheetSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(FORMAT).option("path", path).option("splitBytes", split_bytes).load()


def save(spreadsheets: DataFrame, folder: str, per_folder: int = 0) -> None:
    """Add files (name, content) to a folder in any store; each is written by an executor and shows when all are written.

    More files than the driver should list are dealt into folders of `per_folder`, in folder/dealt, if the store can
    rename folders. cells() finds them there; names must be new then, for none is looked up to be replaced.
    """
    spreadsheets.sparkSession.dataSource.register(SpreadsheetSource)
    spreadsheets.select("name", "content").write.format(FORMAT).mode("append").option("path", folder).option("perFolder", per_folder).save()
