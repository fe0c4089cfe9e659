"""Files of shared storage as tasks open them, by URI."""

from __future__ import annotations

import re
import sys

from pyarrow import fs
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it; a plain path is local."""
    uri = re.sub(r"^file:/+", "file:///", uri)
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def files_below(uri: str, suffix: str) -> list[tuple[str, int]]:
    """``(path, bytes)`` of the files of a folder whose names end so, by path; a missing folder has none.

    Names that begin with a dot or an underscore, or lie in folders with such names, do not count.
    """
    system, path = opened(uri)
    found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    root = len(path.rstrip("/")) + 1
    return sorted(
        (f.path, f.size)
        for f in found
        if f.type == fs.FileType.File
        and f.path.endswith(suffix)
        and not re.search(r"(^|/)[._]", f.path[root:])
    )
