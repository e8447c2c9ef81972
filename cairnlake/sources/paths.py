"""Files by path or URI, wherever pyarrow has a file system for it (file, hdfs, s3, gs)."""

from __future__ import annotations

import fnmatch
import os
import uuid

from pyarrow import fs as pafs


def _at(path: str) -> tuple[pafs.FileSystem, str, str]:
    """(file system, path in it, what stands before that in the URI); ``file:`` with any number of slashes is local."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), os.path.abspath(path), ""
    system, inner = pafs.FileSystem.from_uri(path)
    return system, inner, path[: len(path) - len(inner)]


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, of the files in a folder, or of those that a pattern in the last part names; hidden ones are left out."""
    folder, _, pattern = path.rpartition("/")
    globbed = any(c in pattern for c in "*?[")
    system, inner, before = _at(folder if globbed else path)
    info = system.get_file_info(inner)
    if info.type == pafs.FileType.File:
        return [(before + inner, info.size)]
    if info.type == pafs.FileType.NotFound:
        return []
    found = system.get_file_info(pafs.FileSelector(inner))
    wanted = [f for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")) and (not globbed or fnmatch.fnmatch(f.base_name, pattern))]
    return sorted((before + f.path, f.size) for f in wanted)


def open_file(path: str):
    """A file to read at any place."""
    system, inner, _ = _at(path)
    return system.open_input_file(inner)


def write_file(path: str, data: bytes) -> str:
    """Write a file under another name, then move it to its own, so that none is ever partial; returns the path."""
    system, inner, before = _at(path)
    folder, _, name = inner.rpartition("/")
    system.create_dir(folder, recursive=True)
    temporary = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(temporary) as out:
        out.write(data)
    system.move(temporary, inner)
    return before + inner
