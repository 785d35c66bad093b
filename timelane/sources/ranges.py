"""Byte ranges of files as a data source, for files above the 2 GiB of ``binaryFile``.

    spark.dataSource.register(RangeSource)
    spark.read.format("byteranges").option("path", folder).option("rangeBytes", n).load()

Each range is one partition, so a single large file is read by many tasks.
"""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, start bigint, length bigint, content binary"
RANGE_BYTES = 64 * 1024 * 1024


def _open(path: str):
    """File system and path below it; any scheme Arrow knows, plain paths are local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class ByteRange(InputPartition):
    def __init__(self, uri: str, path: str, start: int, length: int):
        self.uri, self.path, self.start, self.length = uri, path, start, length


class RangeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.suffix = options.get("suffix", "").lower()
        self.size = int(options.get("rangeBytes", RANGE_BYTES))
        if self.size <= 0:
            raise ValueError("rangeBytes must be positive")

    def partitions(self):
        from pyarrow import fs

        system, path = _open(self.root)
        info = system.get_file_info(path)
        if info.type == fs.FileType.Directory:
            found = system.get_file_info(fs.FileSelector(path, recursive=True))
        else:
            found = [info]
        out = []
        for f in sorted(found, key=lambda f: f.path):
            if f.type == fs.FileType.File and f.path.lower().endswith(self.suffix):
                for start in range(0, f.size, self.size):
                    length = min(self.size, f.size - start)
                    out.append(ByteRange(self.root, f.path, start, length))
        return out

    def read(self, part):
        if part is None:
            return
        system, _ = _open(part.uri)
        with system.open_input_file(part.path) as f:
            data = f.read_at(part.length, part.start)
        yield (part.path, part.start, len(data), data)


class RangeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "byteranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options)
