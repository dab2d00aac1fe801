"""Whole-file access in the shared folder from Python, by Spark's paths."""

from __future__ import annotations

import re
import uuid

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; ``file:/x`` as Spark writes it is accepted too."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def read(uri: str, start: int = 0, size: int | None = None) -> bytes:
    system, path = at(uri)
    with system.open_input_file(path) as f:
        f.seek(start)
        return f.read(size) if size is not None else f.read()


def write_whole(uri: str, data: bytes) -> None:
    """Write under a temporary name and move into place, so that a half-written file is never read.

    Equal content may be written to one name by several attempts of a task; the last move wins.
    """
    system, path = at(uri)
    folder, name = path.rsplit("/", 1)
    system.create_dir(folder, recursive=True)
    temporary = f"{folder}/_temporary-{uuid.uuid4().hex}-{name}"
    with system.open_output_stream(temporary, compression=None) as f:  # names don't tell how to write
        f.write(data)
    system.move(temporary, path)
