"""Binary arrays in the shared folder, written by one task and memory-mapped by others.

The folder may be on any file system that Arrow can open (a mounted path, HDFS, an object store). Where it is
a path, readers map the file itself; elsewhere a worker copies a file to its own temporary folder when it
first needs it, maps the copy and removes it when it ends. A lost copy is fetched again.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

import numpy as np
from pyarrow import fs

_copies: list[str] = []


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_arrays(uri: str, **arrays: np.ndarray) -> None:
    """One file of several arrays. A repeated task writes the same content; the rename makes it appear at once."""
    system, path = _open(uri)
    part = f"{path}.{uuid.uuid4().hex}.part"
    head = ";".join(f"{k},{a.dtype.str},{len(a)}" for k, a in arrays.items()).encode()
    system.create_dir(os.path.dirname(path), recursive=True)
    with system.open_output_stream(part) as f:
        f.write(np.int64(len(head)).tobytes())
        f.write(head.ljust(-(-len(head) // 8) * 8))
        for a in arrays.values():
            if a.nbytes:
                f.write(np.ascontiguousarray(a).data)
            f.write(b"\0" * (-a.nbytes % 8))
    system.move(part, path)


def _copy(system: fs.FileSystem, path: str) -> str:
    if not _copies:
        _copies.append(tempfile.mkdtemp(prefix="arrays-"))
        atexit.register(shutil.rmtree, _copies[0], True)
    local = os.path.join(_copies[0], uuid.uuid4().hex)
    fs.copy_files(path, local, source_filesystem=system, destination_filesystem=fs.LocalFileSystem())
    return local


def map_arrays(uri: str) -> dict[str, np.ndarray] | None:
    """The arrays of a file, memory-mapped; None if no task wrote it."""
    system, path = _open(uri)
    if system.get_file_info(path).type != fs.FileType.File:
        return None
    if system.type_name == "local":
        raw = np.memmap(path, np.uint8, "r")
    else:
        path = _copy(system, path)
        raw = np.memmap(path, np.uint8, "r")
        os.unlink(path)  # the mapping stays, and the space goes with it
    n = int(raw[:8].view(np.int64)[0])
    at = 8 + -(-n // 8) * 8
    out = {}
    for item in bytes(raw[8 : 8 + n]).decode().split(";"):
        name, kind, length = item.split(",")
        size = int(length) * np.dtype(kind).itemsize
        out[name] = raw[at : at + size].view(kind)
        at += -(-size // 8) * 8
    return out
