"""Files of any file system that Arrow knows (local paths, ``hdfs://``, ``s3://``, ``gs://``), read as bytes by executors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fnmatch import fnmatchcase
from urllib.parse import quote

from pyarrow import fs

BLOCK = 4 << 20


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a URI or a local path."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(quote(path, safe="%/:?#[]@!$&'()*+,;=~"))
    return fs.LocalFileSystem(), path


def list_files(pattern: str) -> list[str]:
    """Files that match a glob (``*``, ``?``, ``[]`` in any part of the path), sorted, named with the pattern's own scheme."""
    scheme = pattern.partition("://")[0] + "://" if "://" in pattern else ""
    if scheme and any(mark in pattern for mark in "*?["):
        plain = pattern[: min(pattern.find(mark) for mark in "*?[" if mark in pattern)].rpartition("/")[0]
        system, root = locate(plain + "/")
        inner = root.rstrip("/") + pattern[len(plain) :]
    else:
        system, inner = locate(pattern)
    if not any(mark in inner for mark in "*?["):
        found = [inner] if system.get_file_info(inner).type == fs.FileType.File else []
        found = found or _below(system, inner, False)
    else:
        parts = inner.split("/")
        fixed = next(i for i, part in enumerate(parts) if any(mark in part for mark in "*?["))
        folders = ["/".join(parts[:fixed]) or ("/" if inner.startswith("/") else ".")]
        for at, part in enumerate(parts[fixed:], fixed):
            last = at == len(parts) - 1
            folders = [p for folder in folders for p in _below(system, folder, not last) if fnmatchcase(p.rpartition("/")[2], part)]
        found = folders
    host = pattern[: len(pattern) - len(inner)] if scheme and pattern.endswith(inner) else ""
    if scheme and not host:
        host = scheme if not scheme.startswith("file") else "file://"
        if scheme.startswith("hdfs"):
            host = scheme + pattern[len(scheme) :].partition("/")[0]
    return sorted(host + p for p in found)


def _below(system: fs.FileSystem, folder: str, folders: bool) -> list[str]:
    infos = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    kind = fs.FileType.Directory if folders else fs.FileType.File
    return [info.path for info in infos if info.type == kind]


class Truncated(Exception):
    """A compressed file that ends too early or whose bytes are damaged."""


def read_bytes(path: str) -> Iterator[bytes]:
    """A file's bytes block by block, those of a ``.gz`` file decompressed (any number of members).

    What could be decompressed comes out before :class:`Truncated` is raised.
    """
    system, inner = locate(path)
    with system.open_input_stream(inner, compression=None) as source:
        if not path.endswith(".gz"):
            while block := source.read(BLOCK):
                yield block
            return
        unpack, begun = zlib.decompressobj(31), False
        while block := source.read(BLOCK):
            while block:
                begun = True
                try:
                    data = unpack.decompress(block)
                except zlib.error as error:
                    raise Truncated(str(error)) from error
                if data:
                    yield data
                block = unpack.unused_data
                if unpack.eof:
                    unpack, begun = zlib.decompressobj(31), False
                    block = block.lstrip(b"\0")
        if begun:
            raise Truncated("the file ends inside a compressed member")


def read_lines(path: str) -> Iterator[tuple[int, bytes]]:
    """Lines with the byte offset each begins at, line ends kept; :class:`Truncated` is raised behind the last whole block's."""
    rest, at = b"", 0
    try:
        for block in read_bytes(path):
            lines = (rest + block).split(b"\n")
            rest = lines.pop()
            for line in lines:
                yield at, line + b"\n"
                at += len(line) + 1
    except Truncated:
        if rest:
            yield at, rest
        raise
    if rest:
        yield at, rest
