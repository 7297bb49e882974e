"""Binary files in the shared folder, from tasks: any store that pyarrow knows by URI, or a shared mount."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def _located(uri: str):
    if "://" not in uri:
        uri = uri.removeprefix("file:")
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


@contextmanager
def writing(uri: str):
    """A new file that appears under ``uri`` only when it is whole, so a lost or repeated attempt leaves no half file."""
    store, path = _located(uri)
    folder = path.rsplit("/", 1)[0]
    store.create_dir(folder, recursive=True)
    part = f"{folder}/_{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        yield out
    store.move(part, path)


def reading(uri: str):
    store, path = _located(uri)
    return store.open_input_file(path)
