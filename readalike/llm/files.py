"""Files in the shared folder, opened from inside tasks by URI."""

from __future__ import annotations

import uuid
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyarrow import fs


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; without a scheme it is a path that all executors share."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path)
    return fs.FileSystem.from_uri(uri)


def write_whole(uri: str, pieces: list[bytes | memoryview]) -> None:
    """Write beside the target and move into place, so a repeated or lost attempt leaves
    either nothing or a whole file under the name."""
    system, path = located(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with system.open_output_stream(draft) as out:
        for piece in pieces:
            out.write(piece)
    system.move(draft, path)


def open_ranges(uri: str) -> pa.NativeFile:
    """Random access for range reads."""
    system, path = located(uri)
    return system.open_input_file(path)
