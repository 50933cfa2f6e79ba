"""Small binary files in the shared folder, by path or URI, from the driver or a task."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse


def _local(path: str) -> str | None:
    u = urlparse(path)
    return u.path if u.scheme == "file" else path if not u.scheme else None


def put(path: str, data: bytes) -> None:
    """Writes a file; a second attempt of a task replaces it by the same content at once."""
    here = _local(path)
    if here:
        os.makedirs(os.path.dirname(here), exist_ok=True)
        part = f"{here}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, here)
        return
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(inner), recursive=True)
    with store.open_output_stream(inner) as f:
        f.write(data)


def get(path: str):
    """A file's bytes, memory-mapped where the shared folder is a mounted one."""
    import pyarrow as pa

    here = _local(path)
    if here:
        with pa.memory_map(here) as m:
            return m.read_buffer()
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    with store.open_input_file(inner) as f:
        return pa.py_buffer(f.read())


def exists(path: str) -> bool:
    here = _local(path)
    if here:
        return os.path.exists(here)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.get_file_info(inner).type != fs.FileType.NotFound


def blank(path: str, size: int) -> bool:
    """Makes a file of ``size`` zero bytes that takes no room yet; False where only whole files can be put."""
    here = _local(path)
    if not here:
        return False
    os.makedirs(os.path.dirname(here), exist_ok=True)
    with open(here, "wb") as f:
        f.truncate(size)
    return True


def put_at(path: str, offset: int, data: bytes) -> None:
    """Writes a piece of a file made by :func:`blank`; a second attempt writes the same bytes again."""
    with open(_local(path), "r+b") as f:
        f.seek(offset)
        f.write(data)


def mapped(path: str):
    """The local path of a file that can be memory-mapped, or None."""
    here = _local(path)
    return here if here and os.path.isfile(here) else None
