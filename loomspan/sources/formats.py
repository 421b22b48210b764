"""Data sources of the library's own: ``spark.read.format("loomspan_text")`` and ``("loomspan_http")``.

Register them once for a session with register(). Work is dealt out as input
partitions, and what can't be read is a row with an error instead of a failed
task. Folders are listed and files are read through Arrow's file systems, so a
path may have any scheme that these know; a plain path is a local one.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from posixpath import basename
from urllib.request import Request, urlopen

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..shipping import ship

TEXT = "doc_id string, text string, filepath string, file_size int, hash string, error string"
PAGE = "page int, item string, error string"


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(TextSource)
    spark.dataSource.register(HttpSource)


def decoded(content: bytes) -> str:
    """UTF-8 where it is that, else Latin-1; line ends become \\n."""
    try:
        text = content.decode()
    except UnicodeDecodeError:
        text = content.decode("latin-1")
    return re.sub("\r\n?", "\n", text)


@dataclass
class _Files(InputPartition):
    """Paths that one task reads."""

    paths: list[str]

    def __init__(self, paths: list[str]) -> None:
        super().__init__(None)
        self.paths = paths


class _Folder:
    """The files of a folder that match a pattern, not those of its subfolders, and how they are read."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options.get("path", "")
        if not self.path:
            raise ValueError("loomspan_text needs a path: load(folder)")
        self.suffix = options.get("suffix", ".txt")
        self.per_task = int(options.get("files_per_task", "16"))

    def _system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("/") else f"file:{self.path}")

    def listed(self) -> list[fs.FileInfo]:
        system, root = self._system()
        found = [x for x in system.get_file_info(fs.FileSelector(root)) if x.is_file and x.path.endswith(self.suffix)]
        return sorted(found, key=lambda x: x.path)

    def dealt(self, paths: list[str]) -> list[_Files]:
        return [_Files(paths[i : i + self.per_task]) for i in range(0, len(paths), self.per_task)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        system, _ = self._system()
        for path in partition.paths:
            doc_id = basename(path).rpartition(".")[0]
            try:
                with system.open_input_stream(path) as f:
                    content = f.read()
                text = decoded(content)
                yield doc_id, text, path, len(text), hashlib.md5(content).hexdigest(), None  # noqa: S324  tells files apart
            except OSError as e:
                yield doc_id, None, path, None, None, str(e)


class _TextReader(_Folder, DataSourceReader):
    def partitions(self) -> list[_Files]:
        return self.dealt([x.path for x in self.listed()])


class _TextStream(_Folder, DataSourceStreamReader):
    """New files in order of their time of change and path; an offset is the last one's. A file that is changed comes again."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"changed": -1, "path": ""}

    def _after(self) -> list[tuple[int, str]]:
        return sorted((x.mtime_ns, x.path) for x in self.listed())

    def latestOffset(self) -> dict:  # noqa: N802
        every = self._after()
        return {"changed": every[-1][0], "path": every[-1][1]} if every else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[_Files]:
        low, high = (start["changed"], start["path"]), (end["changed"], end["path"])
        return self.dealt([path for changed, path in self._after() if low < (changed, path) <= high])

    def commit(self, end: dict) -> None:
        """Nothing is kept: offsets alone say what was read."""


class TextSource(DataSource):
    """Text files of a folder: doc_id, text, filepath, file_size, hash, error. Options: path, suffix (.txt), files_per_task (16). Also a stream."""

    @classmethod
    def name(cls) -> str:
        return "loomspan_text"

    def schema(self) -> str:
        return TEXT

    def reader(self, schema) -> DataSourceReader:
        return _TextReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _TextStream(self.options)


class _Pages(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        super().__init__((first, last))
        self.first, self.last = first, last


class _HttpReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.url, self.pages = options["url"], int(options["pages"])
        self.per_task = int(options.get("pages_per_task", "8"))
        self.timeout = float(options.get("timeout", "60"))
        self.headers = {"Authorization": f"Bearer {options['key']}"} if options.get("key") else {}

    def partitions(self) -> list[_Pages]:
        return [_Pages(i, min(self.pages, i + self.per_task)) for i in range(0, self.pages, self.per_task)]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        for page in range(partition.first, partition.last):
            try:
                with urlopen(Request(self.url.replace("{page}", str(page)), headers=self.headers), timeout=self.timeout) as answer:  # noqa: S310
                    items = json.load(answer)
                for item in items if isinstance(items, list) else [items]:
                    yield page, json.dumps(item, ensure_ascii=False), None
            except (OSError, ValueError) as e:
                yield page, None, str(e)


class HttpSource(DataSource):
    """JSON pages behind HTTP: page, item (JSON of each element of the page's list), error. Options: url with {page} in it, pages, pages_per_task (8), timeout, key."""

    @classmethod
    def name(cls) -> str:
        return "loomspan_http"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema) -> DataSourceReader:
        return _HttpReader(self.options)
