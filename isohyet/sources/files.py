"""Files on any file system that Arrow knows: listing them, and reading ranges of them."""

from __future__ import annotations

from collections.abc import Callable


def opened(path: str) -> Callable[[int, int], bytes] | None:
    """A reader of ranges of a file on any file system that Arrow knows; None on others."""
    from pyarrow import fs

    try:
        system, name = fs.FileSystem.from_uri(path)
        f = system.open_input_file(name)
    except (ValueError, NotImplementedError, OSError):
        return None

    def read(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)

    return read


def listed(path: str) -> list[str]:
    """The files that a path names: one, all below a folder, or those that a pattern in its last part fits."""
    from fnmatch import fnmatch

    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    scheme = path[: len(path) - len(at)] if path.endswith(at) else ""
    folder, _, last = at.rpartition("/")
    if any(c in last for c in "*?["):
        found = [f.path for f in system.get_file_info(fs.FileSelector(folder)) if fnmatch(f.base_name, last)]
    elif system.get_file_info(at).type == fs.FileType.Directory:
        found = [f.path for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
    else:
        found = [at]
    return [scheme + f for f in sorted(found)]


def reachable(path: str) -> bool:
    """Whether Arrow can list what a path names."""
    try:
        return bool(listed(path))
    except (ValueError, NotImplementedError, OSError):
        return False
