"""Whole-file writes and range reads in the shared folder, by any file system that a URI names."""

from __future__ import annotations

import uuid

from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_file(uri: str, parts: list[bytes]) -> int:
    """Write under another name, then move into place: a task that runs twice leaves the same file, never half of one."""
    system, path = locate(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
    system.move(draft, path)
    return sum(map(len, parts))


class RangeFile:
    """Reads ranges of one file."""

    def __init__(self, uri: str) -> None:
        system, path = locate(uri)
        self._file = system.open_input_file(path)
        self.size = self._file.size()

    def read(self, at: int, n: int) -> bytes:
        got = self._file.read_at(n, at)
        if len(got) != n:
            raise ValueError(f"file ends at {self.size}, wanted {at}..{at + n}")
        return got

    def close(self) -> None:
        self._file.close()
