"""Files of our own formats in the shared folder, written and read by tasks."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or an absolute path (local, HDFS, S3 and others), and the path in it."""
    return fs.FileSystem.from_uri(uri)


@contextmanager
def writing(uri: str):
    """A binary stream that appears under uri only when it is complete, so that a repeated task is harmless."""
    store, path = filesystem(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with store.open_output_stream(part) as out:
            yield out
        store.move(part, path)
    except BaseException:
        try:
            store.delete_file(part)
        except OSError:
            pass
        raise


@contextmanager
def reading(uri: str):
    """A random-access binary file."""
    store, path = filesystem(uri)
    with store.open_input_file(path) as f:
        yield f
