"""File calls inside tasks: on mounts through the operating system, on other URIs through pyarrow.

Both kinds list, stat and open by the same three functions. Paths travel as text. Bytes of a name that
are no UTF-8 are written as U+FFFD and two hex digits, and a real U+FFFD as itself and two
underscores, so every name has one text and every text one name.

The functions of this module travel to the executors by value.
"""

from __future__ import annotations

import os
import re
import stat
import sys
from collections.abc import Iterator
from typing import NamedTuple

from pyspark import cloudpickle

_ODD = re.compile("[�\udc80-\udcff]")
_WRITTEN = re.compile("�(__|[0-9a-f]{2})")
_URI = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*)://[^/]*")


class Attributes(NamedTuple):
    size: int
    modified_ms: int
    regular: bool


def to_text(path: str) -> str:
    """The text of a path as the operating system gives it."""
    return _ODD.sub(lambda m: "�__" if m[0] == "�" else f"�{ord(m[0]) - 0xDC00:02x}", path)


def to_path(text: str) -> str:
    if "�" not in text:
        return text
    return _WRITTEN.sub(lambda m: "�" if m[1] == "__" else chr(0xDC00 + int(m[1], 16)), text)


class Mount:
    """Folders that every executor sees."""

    def entries(self, folder: str) -> Iterator[tuple[str, bool, bool]]:
        """Path, whether it is a folder, whether it is a link; links are not followed."""
        with os.scandir(to_path(folder)) as found:
            for entry in found:
                yield to_text(entry.path), entry.is_dir(follow_symlinks=False), entry.is_symlink()

    def attributes(self, path: str, follow: bool = True) -> Attributes:
        found = os.stat(to_path(path)) if follow else os.lstat(to_path(path))
        return Attributes(found.st_size, found.st_mtime_ns // 1_000_000, stat.S_ISREG(found.st_mode))

    def open(self, path: str):
        return open(to_path(path), "rb", buffering=0)

    def open_regular(self, path: str):
        """The open file, or None if it is not a regular one. A pipe is not waited for."""
        number = os.open(to_path(path), os.O_RDONLY | os.O_NONBLOCK | os.O_CLOEXEC)
        try:
            if stat.S_ISREG(os.fstat(number).st_mode):
                return os.fdopen(number, "rb", buffering=0)
        except BaseException:
            os.close(number)
            raise
        os.close(number)
        return None


class Store:
    """A store behind a URI, such as ``hdfs://`` or ``s3://``; it has no links."""

    def __init__(self, system, prefix: str, base: str = "") -> None:
        self.system, self.prefix, self.base = system, prefix, base

    def _inner(self, path: str) -> str:
        return self.base + path[len(self.prefix) :]

    def entries(self, folder: str) -> Iterator[tuple[str, bool, bool]]:
        from pyarrow import fs

        own = self.system.get_file_info(self._inner(folder))
        if own.type == fs.FileType.NotFound:
            raise FileNotFoundError(2, "No such file or directory")
        if own.type == fs.FileType.File:
            raise NotADirectoryError(20, "Not a directory")
        for found in self.system.get_file_info(fs.FileSelector(self._inner(folder))):
            yield self.prefix + found.path[len(self.base) :], found.type == fs.FileType.Directory, False

    def attributes(self, path: str, follow: bool = True) -> Attributes:
        from pyarrow import fs

        found = self.system.get_file_info(self._inner(path))
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(2, "No such file or directory")
        return Attributes(found.size or 0, (found.mtime_ns or 0) // 1_000_000, found.type == fs.FileType.File)

    def open(self, path: str):
        return self.system.open_input_stream(self._inner(path), compression=None)

    def open_regular(self, path: str):
        return self.open(path) if self.attributes(path).regular else None


class Files:
    """The file system of each path, opened once per task."""

    def __init__(self) -> None:
        self.mount, self.stores = Mount(), {}

    def of(self, path: str) -> Mount | Store:
        uri = _URI.match(path)
        if not uri:
            return self.mount
        if uri[0] not in self.stores:
            from pyarrow import fs

            system, base = fs.FileSystem.from_uri(uri[0] + "/")
            self.stores[uri[0]] = Store(system, uri[0], base.rstrip("/"))
        return self.stores[uri[0]]


def root_text(root: str) -> str:
    """A root as the scan carries it: an absolute path for mounts and ``file:`` URIs, else the URI."""
    if root.startswith("file:"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    if _URI.match(root):
        return root.rstrip("/")
    return to_text(os.path.abspath(root))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
