"""A Spark data source of TEI files: ``spark.read.format("tei").load(folder)`` gives parsed paragraphs, without a whole file in memory."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.tei import PARSED, Parsed, parse

#: Bytes of files that one partition reads, and of a file that are read at once.
PARTITION_BYTES, BLOCK_BYTES = 64 << 20, 1 << 20


@dataclass
class Files(InputPartition):
    paths: list[str]


class TeiSource(DataSource):
    """Options: ``path`` (a folder or file, with the scheme of its store or none), ``partitionBytes``."""

    @classmethod
    def name(cls) -> str:
        return "tei"

    def schema(self) -> str:
        return PARSED

    def reader(self, schema) -> DataSourceReader:
        return TeiReader(self.options["path"], int(self.options.get("partitionBytes", PARTITION_BYTES)))


class TeiReader(DataSourceReader):
    """Small files share a partition, a large one has its own. A file that does not parse is its error only: its well-formedness is checked
    before its first paragraph is given out, since that cannot be taken back."""

    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, place = self._store()
        info = store.get_file_info(place)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else [f for f in store.get_file_info(fs.FileSelector(place)) if f.is_file and f.base_name.endswith(".xml")]
        parts: list[Files] = []
        held = self.size
        for f in sorted(found, key=lambda f: f.path):
            if held + f.size > self.size:
                parts.append(Files([]))
                held = 0
            parts[-1].paths.append(f.path)
            held += f.size
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[Parsed]:
        from xml.parsers import expat

        store, _ = self._store()

        def blocks(path: str) -> Iterator[bytes]:
            with store.open_input_stream(path) as stream:
                while block := stream.read(BLOCK_BYTES):
                    yield block

        for path in partition.paths:
            problem = path.rsplit("/", 1)[-1].removesuffix(".xml")
            check = expat.ParserCreate()
            try:
                for block in blocks(path):
                    check.Parse(block)
                check.Parse(b"", True)
            except expat.ExpatError as e:
                yield problem, -1, None, [], str(e), 0
                continue
            yield from parse(problem, blocks(path))


def read_tei(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """``PARSED`` rows of every ``*.xml`` file of a folder, for ``tei.paragraphs``."""
    spark.dataSource.register(TeiSource)
    return spark.read.format("tei").options(**options).load(folder)
