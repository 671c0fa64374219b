"""Files by path, on the driver and on executors alike: local ones, and those of any file system that Arrow knows (s3, gs, hdfs)."""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

from pyarrow import fs as arrow_fs


def locate(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it. file: and plain paths are local, taken as they are (no escapes) if plain."""
    if path.startswith("file:"):
        return arrow_fs.LocalFileSystem(), unquote(urlparse(path).path)
    if "://" in path:
        return arrow_fs.FileSystem.from_uri(path)
    return arrow_fs.LocalFileSystem(), path


def list_dir(directory: str) -> Iterator[tuple[str, int, int]]:
    """(name, modification time in microseconds, size) of the files of a directory itself, whatever their names begin with."""
    system, at = locate(directory)
    if isinstance(system, arrow_fs.LocalFileSystem):  # one by one, so a directory may hold any number of them
        with os.scandir(at) as found:
            for entry in found:
                if entry.is_file():
                    state = entry.stat()
                    yield entry.name, state.st_mtime_ns // 1000, state.st_size
        return
    for info in system.get_file_info(arrow_fs.FileSelector(at)):
        if info.type == arrow_fs.FileType.File:
            yield info.base_name, (info.mtime_ns or 0) // 1000, info.size


def read_bytes(path: str) -> bytes:
    system, at = locate(path)
    with system.open_input_stream(at, compression=None) as f:
        return f.read()


@contextlib.contextmanager
def placed(path: str) -> Iterator:
    """A stream whose bytes stand at path once the block has ended well, put there by one rename; nothing stands there otherwise.

    The name that is written to does not end like path's, so that no listing by suffix sees half a file.
    """
    system, at = locate(path)
    folder, name = at.rsplit("/", 1) if "/" in at else (".", at)
    half = f"{folder}/.{uuid.uuid4().hex}-{name}.part"
    system.create_dir(folder, recursive=True)
    with contextlib.ExitStack() as undo:
        undo.callback(lambda: system.get_file_info(half).type == arrow_fs.FileType.File and system.delete_file(half))
        with system.open_output_stream(half, compression=None) as out:
            yield out
        system.move(half, at)
