"""Byte streams in bounded memory."""

from __future__ import annotations

import os
import uuid
from pathlib import Path


class Spool:
    """Bytes written once and read many times: in memory up to a bound, beyond it in a file of ``folder``.

    On a cluster the folder is a shared one, as ``spark.checkpoint.dir`` names it; without
    a folder everything stays in memory. Closing removes the file.
    """

    def __init__(self, data: bytes = b"", most_in_memory: int = 100 << 20, folder: str | os.PathLike | None = None):
        self._most, self._folder, self._path = max(1, most_in_memory), folder, None
        self._memory = bytearray()
        self._size = 0
        self.write(data)

    def write(self, data: bytes) -> int:
        if self._path is None and self._folder is not None and self._size + len(data) > self._most:
            os.makedirs(self._folder, exist_ok=True)
            self._path = Path(self._folder) / f"spool-{uuid.uuid4().hex}"
            self._path.write_bytes(self._memory)
            self._memory = bytearray()
        if self._path is None:
            self._memory += data
        else:
            with self._path.open("ab") as f:
                f.write(data)
        self._size += len(data)
        return len(data)

    def __len__(self) -> int:
        return self._size

    @property
    def in_memory(self) -> bool:
        return self._path is None

    def reader(self):
        """The stream from its beginning; each reader has a place of its own."""
        import io

        return io.BytesIO(self._memory) if self._path is None else self._path.open("rb")

    def close(self) -> None:
        if self._path is not None:
            self._path.unlink(missing_ok=True)
        self._memory, self._path, self._size = bytearray(), None, 0

    def into_bytes(self) -> bytes:
        with self.reader() as r:
            data = r.read()
        self.close()
        return data


def temporary_folder(name: str | None, root: str | os.PathLike) -> Path | None:
    """The folder a setting names: none where it is null or empty, an absolute one as it is, others below ``root``."""
    if not name:
        return None
    return Path(name) if os.path.isabs(name) else Path(root) / name
