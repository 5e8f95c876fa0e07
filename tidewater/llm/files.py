"""Files of an operator's own format, in the shared folder, read and written from executors by any path pyarrow knows."""

from __future__ import annotations

import json

import numpy as np
from pyarrow import fs


def open_path(url: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(url if "://" in url or url.startswith("file:") else "file://" + url)


def normal(url: str) -> str:
    """Hadoop writes file:/x; URIs are file:///x."""
    return "file://" + url[5:] if url.startswith("file:/") and not url.startswith("file://") else url


class Atomic:
    """A file that appears under its name only when it is complete, so a lost or repeated task leaves no half of one."""

    def __init__(self, url: str, attempt: int):
        self.files, self.path = open_path(normal(url))
        self.files.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.part = f"{self.path}.attempt-{attempt}"
        self.stream = self.files.open_output_stream(self.part)

    def write(self, data) -> None:
        self.stream.write(data)

    def tell(self) -> int:
        return self.stream.tell()

    def done(self) -> None:
        self.stream.close()
        self.files.move(self.part, self.path)


def read_array(url: str, dtype, start: int = 0, count: int | None = None) -> np.ndarray:
    """Items of a flat file: memory-mapped where the file is local, else read by range."""
    files, path = open_path(normal(url))
    item = np.dtype(dtype).itemsize
    size = files.get_file_info(path).size
    n = size // item - start if count is None else count
    if n <= 0:
        return np.zeros(0, dtype)
    if isinstance(files, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r", start * item, (n,))
    with files.open_input_file(path) as f:
        f.seek(start * item)
        return np.frombuffer(f.read(n * item), dtype)


def write_json(url: str, value) -> None:
    out = Atomic(url, 0)
    out.write(json.dumps(value).encode())
    out.done()


def read_json(url: str):
    files, path = open_path(normal(url))
    with files.open_input_stream(path) as f:
        return json.loads(f.read())
