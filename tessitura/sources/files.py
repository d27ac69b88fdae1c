"""Bytes to and from any file system that the cluster shares, on the driver or in a task."""

from __future__ import annotations

from pyarrow import fs


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"file:{path}") if not path.startswith("file:/") else (fs.LocalFileSystem(), "/" + path[5:].lstrip("/"))


def put_file(path: str, raw: bytes) -> None:
    """A local path or a URI (file, hdfs, s3 ...); folders are made."""
    system, name = _place(path)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(name) as out:
        out.write(raw)


def get_file(path: str) -> bytes:
    system, name = _place(path)
    with system.open_input_stream(name) as f:
        return f.read()


def listed(folder: str, ending: str) -> list[str]:
    """Files right in a folder, sorted, that end so (in lower case)."""
    system, name = _place(folder)
    prefix = folder[: len(folder) - len(name)] if folder.endswith(name) else ""
    return sorted(prefix + x.path for x in system.get_file_info(fs.FileSelector(name)) if x.is_file and x.path.lower().endswith(ending))
