"""Files that executors write themselves, in a folder all of them see."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyarrow import fs


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path)
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, content: bytes) -> None:
    """The whole file or none of it: written aside and renamed, so a repeated task replaces its own file."""
    system, path = _place(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    aside = f"{os.path.dirname(path)}/.{os.path.basename(path)}.{uuid.uuid4().hex}"
    with system.open_output_stream(aside) as out:
        out.write(content)
    system.move(aside, path)
