"""Named arrays in one file of the shared folder, memory-mapped by those who read them."""

from __future__ import annotations

import ast
import os
import tempfile
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
from pyarrow import fs

#: Files that a worker keeps mapped.
OPEN = 128


def save(parts: dict[str, np.ndarray], uri: str) -> None:
    """Writes the arrays one after the other, aligned, behind a directory of their places."""
    body, where, offset = [], {}, 0
    for k, a in parts.items():
        a = np.ascontiguousarray(a)
        where[k] = (a.dtype.str, len(a), offset)
        pad = -a.nbytes % 64
        body += [a.tobytes(), b"\0" * pad]
        offset += a.nbytes + pad
    head = repr(where).encode()
    head += b" " * (-(len(head) + 8) % 64)
    files, path = fs.FileSystem.from_uri(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    with files.open_output_stream(path, compression=None) as f:
        f.write(len(head).to_bytes(8, "little") + head + b"".join(body))


@lru_cache(maxsize=OPEN)
def load(uri: str) -> dict[str, np.ndarray]:
    """The arrays, memory-mapped; a worker keeps the last OPEN files mapped. A file of a store
    that cannot be mapped is first copied to an unnamed local one, which lives as long as its
    mapping: a cache of the worker's own, which nothing else reads."""
    if urlparse(uri).scheme in ("", "file"):
        data = np.memmap(urlparse(uri).path, np.uint8, "r")
    else:
        files, path = fs.FileSystem.from_uri(uri)
        with files.open_input_stream(path) as source, tempfile.TemporaryFile() as local:
            while block := source.read(8 << 20):
                local.write(block)
            local.flush()
            data = np.memmap(local, np.uint8, "r")
    size = int.from_bytes(data[:8].tobytes(), "little")
    where = ast.literal_eval(data[8 : 8 + size].tobytes().decode())
    body = data[8 + size :]
    return {k: body[o : o + n * np.dtype(t).itemsize].view(t) for k, (t, n, o) in where.items()}
