"""Files by path or URI, on whatever file system they lie; a path without a scheme is local."""

from __future__ import annotations

import os
import uuid
from typing import Any

from pyarrow import fs


def store(path: str) -> tuple[Any, str]:
    """(file system, path on it)."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def listed(path: str, endings: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, size) of the file itself, or of the files with these endings anywhere below it, sorted."""
    system, at = store(path)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(endings))


def open_input(path: str) -> Any:
    system, at = store(path)
    return system.open_input_file(at)


def open_output(path: str) -> Any:
    system, at = store(path)
    system.create_dir(os.path.dirname(at), recursive=True)
    return system.open_output_stream(at)


def synced(path: str) -> None:
    """Makes a local file last; others last once closed."""
    system, at = store(path)
    if isinstance(system, fs.LocalFileSystem):
        with open(at, "rb") as f:
            os.fsync(f.fileno())


def move(old: str, new: str) -> None:
    """Renames within a file system, over what is there."""
    system, at = store(old)
    system.move(at, store(new)[1])


def remove(path: str) -> None:
    system, at = store(path)
    if system.get_file_info(at).type == fs.FileType.File:
        system.delete_file(at)


def read(path: str) -> bytes:
    with open_input(path) as f:
        return f.read()


def replace(path: str, data: bytes) -> None:
    """Writes a file beside the old one and moves it there, so that readers see one or the other."""
    beside = f"{path}.{uuid.uuid4().hex[:8]}"
    with open_output(beside) as f:
        f.write(data)
    synced(beside)
    move(beside, path)
