"""Files in the shared folder, written and read by executors through pyarrow's file systems (local, HDFS, S3, GCS)."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyarrow import fs

#: Tries for one read or write, and the seconds before the second of them (doubled each time).
TRIES, WAIT_S = 4, 0.2


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def retried(f: Callable, *args):
    """f(*args), again after an OSError, with growing waits."""
    for k in range(TRIES):
        try:
            return f(*args)
        except OSError:
            if k == TRIES - 1:
                raise
            time.sleep(WAIT_S * 2**k)


class Upload:
    """A file under a name of this attempt, moved to its final name by close(); an attempt that dies leaves nothing that readers see."""

    def __init__(self, uri: str, name: str):
        self.fs, self.path = opened(uri)
        retried(self.fs.create_dir, self.path)
        self.temp, self.final = f"{self.path}/.{name}.{uuid.uuid4().hex}", f"{self.path}/{name}"
        self.out = self.fs.open_output_stream(self.temp)
        self.at = 0

    def write(self, data: bytes) -> int:
        """Returns where the data begins."""
        start = self.at
        self.out.write(data)
        self.at += len(data)
        return start

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temp, self.final)

    def drop(self) -> None:
        self.out.close()
        self.fs.delete_file(self.temp)


def read_range(handle, start: int, length: int) -> bytes:
    """Exactly length bytes from start on, or OSError."""
    handle.seek(start)
    data = handle.read(length)
    if len(data) != length:
        raise OSError(f"{len(data)} of {length} bytes at {start}")
    return data
