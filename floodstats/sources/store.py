"""Small binary files in any folder that the session's executors can write to: written whole under another name, then renamed."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

from pyarrow import fs


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"[a-z][a-z0-9+.-]*://", path) and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)


def put(path: str, data: bytes) -> None:
    """A task that runs twice, or is lost half-way, leaves the whole file or none."""
    store, at = _place(path)
    folder = at.rsplit("/", 1)[0]
    store.create_dir(folder, recursive=True)
    part = f"{folder}/.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, at)


def get(path: str) -> bytes:
    store, at = _place(path)
    with store.open_input_stream(at) as f:
        return f.read()


def get_range(path: str, start: int, n: int) -> bytes:
    """n bytes from start on; raises where the file ends before."""
    return next(get_ranges(path, [(start, n)]))


def get_ranges(path: str, ranges: Iterable[tuple[int, int]]) -> Iterator[bytes]:
    """get_range of each (start, n), of a file that is opened once."""
    store, at = _place(path)
    with store.open_input_file(at) as f:
        for start, n in ranges:
            f.seek(start)
            data = f.read(n)
            if len(data) < n:
                raise ValueError(f"{path} ends before byte {start + n}")
            yield data


def names(path: str) -> list[str]:
    """Names of the files under a folder, from it on; none if it isn't there."""
    store, at = _place(path)
    found = store.get_file_info(fs.FileSelector(at, allow_not_found=True, recursive=True))
    return [f.path[len(at) :].lstrip("/") for f in found if f.type == fs.FileType.File]


def remove(path: str) -> None:
    """A folder with all in it, if it is there."""
    store, at = _place(path)
    if store.get_file_info(at).type == fs.FileType.Directory:
        store.delete_dir(at)


def move(old: str, new: str) -> None:
    store, at = _place(old)
    to = _place(new)[1]
    store.create_dir(to.rsplit("/", 1)[0], recursive=True)
    store.move(at, to)
