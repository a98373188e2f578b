"""Sinks of named files: tasks write under temporary names, and only the files of attempts that succeeded get their own.

Spark's writer protocol does the rest: a task that runs again writes to a folder of its own, a job that fails leaves nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage


def filesystem(path: str):
    """(file system, path in it) of a URI or a local path."""
    from pyarrow import fs as pafs

    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class FileWriter(DataSourceArrowWriter):
    """Subclasses give ``store(batches, create)``, which calls ``create(name)`` for each file and writes to what it gets."""

    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.job = uuid.uuid4().hex

    def store(self, batches: Iterator, create: Callable) -> None:
        raise NotImplementedError

    def write(self, iterator):
        fs, root = filesystem(self.path)
        temp, done, live = f"{root}/_temporary/{self.job}/{uuid.uuid4().hex}", [], []

        def create(name: str):
            while live:
                live.pop().close()
            if not done:
                fs.create_dir(temp, recursive=True)
            done.append((f"{temp}/{len(done)}", f"{root}/{name}"))
            live.append(fs.open_output_stream(done[-1][0], compression=None))
            return live[-1]

        try:
            self.store(iterator, create)
        finally:
            while live:
                live.pop().close()
        return Written(done)

    def commit(self, messages):
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        named = [f for m in messages if m is not None for f in m.files]
        if len({final for _, final in named}) < len(named):
            self.abort(messages)
            raise ValueError("two tasks wrote a file of the same name: partition the rows by it")
        for temp, final in named:
            fs.move(temp, final)
        self._clear(fs, root)

    def abort(self, messages):
        self._clear(*filesystem(self.path))

    def _clear(self, fs, root):
        from pyarrow import fs as pafs

        for at in (f"{root}/_temporary/{self.job}", f"{root}/_temporary"):
            if fs.get_file_info(at).type == pafs.FileType.Directory and (at.endswith(self.job) or not fs.get_file_info(pafs.FileSelector(at))):
                fs.delete_dir(at)
