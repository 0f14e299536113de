"""Whole files in the shared folder, written by tasks and read by range from any executor."""

from __future__ import annotations

import uuid
from contextlib import contextmanager


def opened(uri: str):
    """(file system, path) for a URI or an absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@contextmanager
def written(uri: str):
    """A stream whose file appears under its name only when complete, so that a task that is run again replaces it whole."""
    system, path = opened(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    out = system.open_output_stream(part)
    try:
        yield out
        out.close()
        system.move(part, path)
    except BaseException:
        out.close()
        system.delete_file(part)
        raise
