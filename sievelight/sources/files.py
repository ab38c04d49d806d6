"""Single files of a local or shared file system, by path or URI."""

from __future__ import annotations

from pyarrow import fs


def _at(path: str) -> tuple[fs.FileSystem, str]:
    """``file:/a`` is written with one slash by some listings."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    if path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), path


def opened(path: str):
    """A file to be read at any place."""
    files, where = _at(path)
    return files.open_input_file(where)


def write(path: str, data: bytes) -> None:
    files, where = _at(path)
    files.create_dir(where.rsplit("/", 1)[0], recursive=True)
    with files.open_output_stream(where) as out:
        out.write(data)


def write_new(path: str, data: bytes) -> bool:
    """Write a file unless it is there; it appears whole or not at all."""
    files, where = _at(path)
    if files.get_file_info(where).type != fs.FileType.NotFound:
        return False
    write(f"{path}.part", data)
    files.move(f"{where}.part", where)
    return True
