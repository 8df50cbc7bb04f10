"""A file for each row: a Spark data source that writes (name, text) below a folder.

    df.write.format("text_files").mode("overwrite").option("path", folder).save()

Tasks write to a folder of their own below ``_staging``; only the commit of the job, on the driver, moves what they have
written to its place, and writes the index (``index.json``: the names, sorted) last. So a reader that finds the index finds
all its files, whole, and a task that fails, or runs twice, leaves nothing behind. Folders may be anything that
``pyarrow.fs`` opens by its address; a bare path is one on a file system that all executors share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

INDEX, STAGING = "index.json", "_staging"


@dataclass
class Written(WriterCommitMessage):
    """What one task has written: its folder, and the names in it."""

    folder: str
    names: list[str]


class TextFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return TextFilesWriter(self.options["path"], overwrite)


class TextFilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def write(self, rows: Iterator) -> Written:
        files, root = self._open()
        folder, names = f"{root}/{STAGING}/{self.job}/{uuid.uuid4().hex}", []
        files.create_dir(folder, recursive=True)
        for row in rows:
            name = row["name"]
            if not name or "/" in name or name in (INDEX, STAGING, ".", ".."):
                raise ValueError(f"not the name of a file: {name!r}")
            with files.open_output_stream(f"{folder}/{name}") as out:
                out.write((row["text"] or "").encode())
            names.append(name)
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = self._open()
        done = [m for m in messages if m is not None]
        names = sorted(n for m in done for n in m.names)
        twice = {a for a, b in zip(names, names[1:], strict=False) if a == b}
        if twice:
            self.abort(messages)
            raise ValueError(f"several rows have one name: {sorted(twice)[:5]}")
        if files.get_file_info(f"{root}/{INDEX}").type == fs.FileType.File:
            with files.open_input_stream(f"{root}/{INDEX}") as f:
                old = json.loads(f.read())
            files.delete_file(f"{root}/{INDEX}")
            if self.overwrite:
                for name in set(old) - set(names):
                    files.delete_file(f"{root}/{name}")
            else:
                names = sorted({*old, *names})
        for m in done:
            for name in m.names:
                files.move(f"{m.folder}/{name}", f"{root}/{name}")
        self._clear(files, root)
        with files.open_output_stream(f"{root}/{INDEX}") as out:
            out.write(json.dumps(names, ensure_ascii=False).encode())

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._open())

    def _clear(self, files: fs.FileSystem, root: str) -> None:
        if files.get_file_info(f"{root}/{STAGING}/{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{STAGING}/{self.job}")
