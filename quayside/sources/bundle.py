"""A report in one call: tables go to files that appear together with their manifest, or not at all.

The sink is a data source whose tasks write below a staging folder; the driver's commit moves the files to their place and
writes the manifest last, and an abort removes what was staged. The folder must be reachable from executors and driver alike;
any file system that Arrow knows will do.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

LINES = "table string, place long, line string"


def open_folder(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class Staged(WriterCommitMessage):
    files: list[tuple[str, str, int, str]]


class BundleWriter(DataSourceWriter):
    def __init__(self, path: str, stamp: str):
        self.path, self.stamp, self.stage = path, stamp, f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Staged:
        """Lines in order of table and place; a task's lines of a table are one staged file."""
        files, (system, root) = [], open_folder(self.path)
        task = TaskContext.get()
        system.create_dir(posixpath.join(root, self.stage))
        out = name = None
        lines, seen = 0, hashlib.sha256()

        def close() -> None:
            if out is not None:
                out.close()
                files.append((name, staged, lines, seen.hexdigest()))

        staged = ""
        for row in iterator:
            if row.table != name:
                close()
                name, lines, seen = row.table, 0, hashlib.sha256()
                staged = posixpath.join(self.stage, f"{name}-{task.partitionId():05d}-{task.taskAttemptId()}")
                out = system.open_output_stream(posixpath.join(root, staged))
            data = (row.line + "\n").encode()
            out.write(data)
            seen.update(data)
            lines += 1
        close()
        return Staged(files)

    def commit(self, messages: list[Staged | None]) -> None:
        system, root = open_folder(self.path)
        tables: dict[str, list[dict]] = {}
        for message in messages:  # in order of partitions, which are ranges of table and place
            for name, staged, lines, digest in message.files if message else ():
                parts = tables.setdefault(name, [])
                final = f"{name}.csv" if not parts else f"{name}.{len(parts)}.csv"
                system.move(posixpath.join(root, staged), posixpath.join(root, final))
                parts.append({"file": final, "lines": lines, "sha256": digest})
        manifest = json.dumps({**json.loads(self.stamp), "tables": tables}, indent=1, sort_keys=True) + "\n"
        with system.open_output_stream(posixpath.join(root, "manifest.json.part")) as out:
            out.write(manifest.encode())
        system.move(posixpath.join(root, "manifest.json.part"), posixpath.join(root, "manifest.json"))
        self.clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self.clear()

    def clear(self) -> None:
        from pyarrow import fs

        system, root = open_folder(self.path)
        if system.get_file_info(posixpath.join(root, self.stage)).type == fs.FileType.Directory:
            system.delete_dir(posixpath.join(root, self.stage))


class BundleSource(DataSource):
    """Options: path, and stamp, a JSON object that goes into the manifest. A folder that has a manifest is refused."""

    @classmethod
    def name(cls) -> str:
        return "quayside_bundle"

    def schema(self) -> str:
        return LINES

    def writer(self, schema, overwrite: bool) -> BundleWriter:
        from pyarrow import fs

        path = self.options["path"]
        system, root = open_folder(path)
        if system.get_file_info(posixpath.join(root, "manifest.json")).type != fs.FileType.NotFound:
            raise FileExistsError(f"{path} holds a report")
        return BundleWriter(path, self.options.get("stamp", "{}"))


def csv_lines(frame: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """table, sort key and line of each row, the header first; text in quotes where it needs them, null as nothing."""
    def cell(c: str):
        text = F.col(c).cast("string") if not frame.schema[c].dataType.typeName() in ("array", "map", "struct") else F.to_json(c)
        return F.coalesce(F.when(text.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text), F.lit(""))

    rows = frame.select(F.lit(name).alias("table"), F.lit(1).alias("part"), F.struct(*order).alias("key"), F.concat_ws(",", *map(cell, frame.columns)).alias("line"))
    return rows


def write_bundle(tables: dict[str, tuple[DataFrame, Sequence[str]]], folder: str, stamp: dict) -> dict:
    """Write every table (frame, columns that order it) as CSV below folder and return the manifest: stamp, and file, lines and
    digest of each part. The same rows give the same bytes; nothing in it tells the time. A failing task leaves no manifest
    and no file."""
    from quayside.operators.panel import numbered

    whole = None
    for name, (frame, order) in sorted(tables.items()):
        head = frame.sparkSession.createDataFrame([(name, -1, ",".join(frame.columns))], LINES)
        lines = numbered(csv_lines(frame, name, order), ["key", "line"], "place").select("table", F.col("place").cast("long"), "line")
        whole = head.unionByName(lines) if whole is None else whole.unionByName(head).unionByName(lines)
    spark = whole.sparkSession
    spark.dataSource.register(BundleSource)
    ranged = whole.repartitionByRange("table", "place").sortWithinPartitions("table", "place")
    ranged.write.format("quayside_bundle").option("path", folder).option("stamp", json.dumps(stamp)).mode("append").save()
    system, root = open_folder(folder)
    with system.open_input_stream(posixpath.join(root, "manifest.json")) as f:
        return json.loads(f.read())
