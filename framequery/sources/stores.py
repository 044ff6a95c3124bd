"""Files of shared stores, as Python sources and sinks on executors reach them."""

from __future__ import annotations

from pyarrow import fs

#: Hadoop's schemes of stores that pyarrow knows by another one.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path) of a URI or an absolute path: local and shared folders, hdfs, s3 (also as s3a) and gs."""
    scheme, sep, rest = uri.partition("://")
    if sep and scheme in _SCHEMES:
        uri = f"{_SCHEMES[scheme]}://{rest}"
    return fs.FileSystem.from_uri(uri)
