"""Files that tasks write to shared storage and that appear when the whole job has succeeded.

A task writes below ``_temporary`` of the target folder, in a folder of its own attempt.  The commit
moves what the successful attempts reported to its final names.  An attempt that fails removes what it
wrote, and commit and abort remove the job's temporary folder; what a killed worker may still leave lies
below a name that readers pass over.  So a folder never shows the file of a failed or repeated attempt.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from strataspark.sources.shared import opened

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHORT_NAME = "committed_files"
# Files that a commit moves at a time.
_MOVERS = 16


@dataclass
class Written(WriterCommitMessage):
    """What one task attempt wrote: its folder, and the files' names below it."""

    folder: str = ""
    names: list[str] = field(default_factory=list)


class CommittedWriter(DataSourceArrowWriter):
    """Tasks call :meth:`write_files`; the rest is the commit."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.target = options["path"]
        self.overwrite = overwrite
        self.job = uuid.uuid4().hex

    def write_files(self, batches: Iterator[pa.RecordBatch], open_file) -> None:
        """Write the rows; ``open_file(name)`` gives a stream for a file of the target folder."""
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = opened(self.target)
        context = TaskContext.get()
        attempt = f"{context.partitionId()}-{context.taskAttemptId()}" if context else "0-0"
        folder = f"{root.rstrip('/')}/_temporary/{self.job}/{attempt}"
        names: list[str] = []
        taken: set[str] = set()
        parents: set[str] = set()

        def open_file(name: str) -> pa.NativeFile:
            if not name or name.startswith("/") or ".." in name.split("/"):
                raise ValueError(f"{name!r} is no name of a file within the folder")
            if name in taken:
                raise ValueError(f"two rows give the file {name!r}")
            parent = f"{folder}/{name}".rpartition("/")[0]
            if parent not in parents:
                system.create_dir(parent, recursive=True)
                parents.add(parent)
            taken.add(name)
            names.append(name)
            return system.open_output_stream(f"{folder}/{name}", compression=None)

        try:
            self.write_files(iterator, open_file)
        except BaseException:
            if system.get_file_info(folder).type == fs.FileType.Directory:
                system.delete_dir(folder)
            raise
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.target)
        root = root.rstrip("/")
        done = [m for m in messages if m is not None]
        taken: set[str] = set()
        for message in done:
            again = taken.intersection(message.names)
            if again:
                self.abort(messages)
                raise ValueError(f"two rows give the file {min(again)!r}")
            taken.update(message.names)
        system.create_dir(root, recursive=True)
        if self.overwrite:
            for entry in system.get_file_info(fs.FileSelector(root)):
                if entry.base_name == "_temporary":
                    continue
                if entry.type == fs.FileType.Directory:
                    system.delete_dir(entry.path)
                else:
                    system.delete_file(entry.path)
        moves = [(f"{message.folder}/{n}", f"{root}/{n}") for message in done for n in message.names]
        for parent in {to.rpartition("/")[0] for _, to in moves}:
            system.create_dir(parent, recursive=True)
        # Storage answers many at once; the first failure is raised.
        with ThreadPoolExecutor(_MOVERS) as pool:
            for _ in pool.map(lambda pair: system.move(*pair), moves):
                pass
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Remove this job's temporary folder, and their parent when no other job writes there."""
        system, root = opened(self.target)
        top = f"{root.rstrip('/')}/_temporary"
        if system.get_file_info(f"{top}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{top}/{self.job}")
        if system.get_file_info(top).type == fs.FileType.Directory and not system.get_file_info(
            fs.FileSelector(top)
        ):
            system.delete_dir(top)


class FilePerRow(CommittedWriter):
    """Rows ``name, content``: each is one file."""

    def write_files(self, batches: Iterator[pa.RecordBatch], open_file) -> None:
        for batch in batches:
            names = batch.column(batch.schema.get_field_index("name"))
            contents = batch.column(batch.schema.get_field_index("content"))
            for name, content in zip(names, contents, strict=True):
                with open_file(name.as_py()) as stream:
                    stream.write(content.as_buffer())


class CommittedFiles(DataSource):
    """``df.select("name", "content").write.format("committed_files").mode(...).save(folder)``."""

    @classmethod
    def name(cls) -> str:
        return SHORT_NAME

    def schema(self) -> StructType:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> CommittedWriter:
        if not {"name", "content"} <= set(schema.names):
            raise ValueError("rows need the columns name and content")
        return FilePerRow(self.options, overwrite)
