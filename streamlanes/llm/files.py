"""Files in shared storage, opened by executors and the driver alike."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse

import pyarrow.fs as pafs


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    scheme = urlparse(path).scheme
    if scheme in ("", "file"):
        return pafs.LocalFileSystem(), unquote(urlparse(path).path) if scheme else path
    return pafs.FileSystem.from_uri(path)


def open_new(path: str):
    """A binary file to write, its folders made. Names must be new: each task attempt uses its own."""
    fs, name = _at(path)
    fs.create_dir(os.path.dirname(name), recursive=True)
    return fs.open_output_stream(name, compression=None)


def open_old(path: str):
    """A binary file to read, with seek()."""
    fs, name = _at(path)
    return fs.open_input_file(name)


def remove(path: str) -> None:
    fs, name = _at(path)
    fs.delete_file(name)
