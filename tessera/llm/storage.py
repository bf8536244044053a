"""Files in the folder that all machines share, written so that a retried task does no harm."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO

from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def make_folder(uri: str) -> None:
    store, path = _at(uri)
    store.create_dir(path, recursive=True)


@contextmanager
def replacing(uri: str) -> Iterator[BinaryIO]:
    """A stream whose bytes appear under ``uri`` only when it has been closed without an error.

    Two attempts of one task write to files of their own; the last rename wins,
    and as both have the same content either may.
    """
    store, path = _at(uri)
    own = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with store.open_output_stream(own) as out:
            yield out
        store.move(own, path)
    except BaseException:
        if store.get_file_info(own).type != fs.FileType.NotFound:
            store.delete_file(own)
        raise


@contextmanager
def reading(uri: str) -> Iterator[BinaryIO]:
    store, path = _at(uri)
    with store.open_input_file(path) as source:
        yield source
