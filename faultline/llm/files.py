"""Binary files in the shared folder, from tasks: any store that pyarrow reaches by URI."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def locate(uri: str) -> tuple[pafs.FileSystem, str]:
    """Filesystem and path of a URI; a plain path or ``file:`` is local."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def attempt_name(folder: str, stem: str, suffix: str) -> str:
    """A name of its own for each task attempt; only the attempt that Spark commits gets into the manifest."""
    fs, path = locate(folder)
    fs.create_dir(path, recursive=True)
    return f"{folder}/{stem}-{uuid.uuid4().hex[:12]}{suffix}"
