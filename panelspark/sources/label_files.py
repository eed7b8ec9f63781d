"""Writers of many small text files, one a key: in hash folders, or as members of zip archives."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Folders that files are spread over, named by two hexadecimal digits.
FOLDERS = 256
#: Bytes of an archive, about, after which a task begins the next one.
ARCHIVE = 32 << 20


def located(path: str) -> tuple:
    """The Arrow file system of a folder, and its path there."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """The files that a task wrote under their final names."""

    files: int


@dataclass
class Archived(WriterCommitMessage):
    """The archives that a task wrote."""

    names: list


class LabelFileWriter(DataSourceWriter):
    """Rows (folder, name, line) that come sorted by name: each file is written under a name of its own and renamed when it
    is whole, so a task that runs twice leaves one whole file."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, rows: Iterator) -> Written:
        store, root = located(self.path)
        made: set[str] = set()
        open_name, out, draft, final, files = None, None, "", "", 0

        def finish() -> None:
            out.close()
            store.move(draft, final)

        for folder, name, line in rows:
            if name != open_name:
                if out is not None:
                    finish()
                if folder not in made:
                    store.create_dir(f"{root}/{folder}", recursive=True)
                    made.add(folder)
                final = f"{root}/{folder}/{name}"
                draft = f"{final}.{uuid.uuid4().hex}.part"
                out, open_name, files = store.open_output_stream(draft), name, files + 1
            out.write(line.encode() + b"\n")
        if out is not None:
            finish()
        return Written(files)


class LabelFiles(DataSource):
    """``df.write.format("label_files").save(path)`` for columns folder, name, line."""

    @classmethod
    def name(cls) -> str:
        return "label_files"

    def schema(self) -> str:
        return "folder string, name string, line string"

    def writer(self, schema, overwrite: bool) -> LabelFileWriter:
        return LabelFileWriter(self.options["path"])


def write_label_files(lines: DataFrame, path: str, tile: str = "tile", order: str = "line_no", split: str | None = None) -> None:
    """``<path>/[split/]<two digits>/<tile>.txt`` with a tile's lines in order. Tiles are dealt to tasks by hash and a
    task holds one line at a time; ``path`` is a folder that every executor reaches (a mount, or a URI that Arrow knows)."""
    lines.sparkSession.dataSource.register(LabelFiles)
    _dealt(lines, tile, order, split).write.format("label_files").mode("append").save(path)


def _dealt(lines: DataFrame, tile: str, order: str, split: str | None) -> DataFrame:
    """(folder, name, line), a file's lines in one task and in order."""
    folder = F.format_string("%02x", F.pmod(F.xxhash64(F.col(tile)), F.lit(FOLDERS)))
    if split is not None:
        folder = F.concat_ws("/", F.col(split), folder)
    named = lines.select(folder.alias("folder"), F.concat(F.col(tile).cast("string"), F.lit(".txt")).alias("name"), F.col(order).alias("_o"), "line")
    return named.repartition("folder", "name").sortWithinPartitions("folder", "name", "_o").select("folder", "name", "line")


class LabelArchiveWriter(DataSourceWriter):
    """Rows as for ``LabelFileWriter``, but its files are members ``folder/name`` of zip archives. Archives get
    their names when the whole job ends; what a lost task leaves behind is never read."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, rows: Iterator) -> Archived:
        store, root = located(self.path)
        store.create_dir(root, recursive=True)
        names: list[str] = []
        archive, out, member, key = None, None, None, None

        def close() -> None:
            member.close()
            archive.close()
            out.close()

        for folder, name, line in rows:
            if (folder, name) != key:
                if archive is not None and out.tell() > ARCHIVE:
                    close()
                    archive = None
                elif member is not None:
                    member.close()
                if archive is None:
                    names.append(f"{root}/{uuid.uuid4().hex}.zip")
                    out = store.open_output_stream(f"{names[-1]}.part")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                key, member = (folder, name), archive.open(f"{folder}/{name}", "w")
            member.write(line.encode() + b"\n")
        if archive is not None:
            close()
        return Archived(names)

    def commit(self, messages: list) -> None:
        store, _ = located(self.path)
        for message in messages:
            for name in message.names if message is not None else ():
                store.move(f"{name}.part", name)

    def abort(self, messages: list) -> None:
        store, _ = located(self.path)
        for message in messages:
            for name in message.names if message is not None else ():
                store.delete_file(f"{name}.part")


class LabelArchives(LabelFiles):
    """``df.write.format("label_archives").save(path)`` for columns folder, name, line."""

    @classmethod
    def name(cls) -> str:
        return "label_archives"

    def writer(self, schema, overwrite: bool) -> LabelArchiveWriter:
        return LabelArchiveWriter(self.options["path"])


def write_label_archives(lines: DataFrame, path: str, tile: str = "tile", order: str = "line_no", split: str | None = None) -> None:
    """S13 for millions of tiles: the same files as ``write_label_files``, byte for byte, as members of zip archives in
    ``path``, so that a file of some hundred bytes costs about that much and not a block of the disk and a directory entry.
    ``unzip`` lays them out as ``write_label_files`` does. Appends: a second run into a folder adds its archives."""
    lines.sparkSession.dataSource.register(LabelArchives)
    _dealt(lines, tile, order, split).write.format("label_archives").mode("append").save(path)


def read_label_archives(spark: SparkSession, path: str) -> DataFrame:
    """(name, line) of every line in the archives of a folder; ``name`` is the member's, with its folders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                    names, found = [], []
                    for info in archive.infolist():
                        own = archive.read(info).decode().split("\n")[:-1]
                        names += [info.filename] * len(own)
                        found += own
                        if len(found) > 50_000:
                            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.string())], ["name", "line"])
                            names, found = [], []
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.string())], ["name", "line"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("content").mapInArrow(run, "name string, line string")
