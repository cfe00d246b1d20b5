"""The shared folder as tasks open it, whatever scheme Spark names it by."""

from __future__ import annotations

import pyarrow.fs as pafs

# The same store under the names that Spark and that Arrow use for it.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "abfs": "abfss"}


def open_folder(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder given as a path or as a URI with one of Spark's schemes."""
    scheme, mark, rest = folder.partition(":")
    if not mark or "/" in scheme:
        return pafs.LocalFileSystem(), folder
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}")
