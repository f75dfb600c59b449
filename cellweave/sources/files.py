"""Files by URI, the same way on the driver and on executors."""

from __future__ import annotations


def opened(uri: str):
    """(file system, path)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def put(uri: str, data: bytes) -> None:
    """Write a whole file: to a name of its own first, so readers never see a part."""
    import uuid

    system, path = opened(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft, compression=None) as f:
        f.write(data)
    system.move(draft, path)


def get(uri: str) -> bytes:
    system, path = opened(uri)
    with system.open_input_file(path) as f:
        return f.read()
