"""Arrays in the shared folder, written whole by one task and memory-mapped by workers."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

import numpy as np


def _local(path: str) -> str | None:
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return path if "://" not in path else None


def save(path: str, array: np.ndarray) -> None:
    """Write under a name of this attempt's own and rename, so that retries can't clash."""
    local = _local(path)
    if local is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        part = f"{local}.{uuid.uuid4().hex}"
        with open(part, "wb") as out:
            np.save(out, array)
        os.replace(part, local)
        return
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(name), recursive=True)
    part = f"{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        np.save(out, array)
    store.move(part, name)


_MAGIC = b"arrays01"


def save_all(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Several arrays in one file that is opened once: a directory, then each at a place
    that suits its type. Written like ``save``."""
    places, at = {}, 0
    for name, a in arrays.items():
        at += -at % 64
        places[name] = (a.dtype.str, len(a), at)
        at += a.nbytes
    head = _MAGIC + json.dumps(places).encode()
    head += b" " * (-(len(head) + 8) % 64)
    whole = np.zeros(8 + len(head) + at, np.uint8)
    whole[:8] = np.frombuffer(len(head).to_bytes(8, "little"), np.uint8)
    whole[8 : 8 + len(head)] = np.frombuffer(head, np.uint8)
    for name, a in arrays.items():
        begin = 8 + len(head) + places[name][2]
        whole[begin : begin + a.nbytes] = np.frombuffer(np.ascontiguousarray(a).tobytes(), np.uint8)
    save(path, whole)


def mapped_all(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file of ``save_all``, mapped."""
    whole = mapped(path)
    size = int.from_bytes(whole[:8].tobytes(), "little")
    head = whole[8 : 8 + size].tobytes()
    if not head.startswith(_MAGIC):
        raise ValueError(f"{path} holds no arrays")
    begin = 8 + size
    return {name: whole[begin + at : begin + at + n * np.dtype(kind).itemsize].view(kind) for name, (kind, n, at) in json.loads(head[len(_MAGIC) :]).items()}


def in_place(path: str) -> bool:
    """Whether an array is mapped where it lies, without a copy of its own."""
    return _local(path) is not None


def mapped(path: str) -> np.ndarray:
    """Memory-map an array. From a store that can't be mapped it is fetched to an
    unnamed temporary file first, which is gone with the worker's mapping."""
    local = _local(path)
    if local is not None:
        return np.load(local, mmap_mode="r")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    handle, temporary = tempfile.mkstemp(suffix=".npy")
    try:
        with os.fdopen(handle, "wb") as out, store.open_input_stream(name) as data:
            while block := data.read(1 << 22):
                out.write(block)
        return np.load(temporary, mmap_mode="r")
    finally:
        os.unlink(temporary)


class Writer:
    """A file in the shared folder that appears under its name only when closed."""

    def __init__(self, path: str) -> None:
        self.local, self.store = _local(path), None
        if self.local is not None:
            self.name = self.local
            os.makedirs(os.path.dirname(self.name), exist_ok=True)
            self.part = f"{self.name}.{uuid.uuid4().hex}"
            self.out = open(self.part, "wb")  # noqa: SIM115
        else:
            from pyarrow import fs

            self.store, self.name = fs.FileSystem.from_uri(path)
            self.store.create_dir(os.path.dirname(self.name), recursive=True)
            self.part = f"{self.name}.{uuid.uuid4().hex}"
            self.out = self.store.open_output_stream(self.part)

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def close(self) -> None:
        self.out.close()
        if self.store is None:
            os.replace(self.part, self.name)
        else:
            self.store.move(self.part, self.name)


def reader(path: str):
    """A binary file in the shared folder, to be read and sought in."""
    local = _local(path)
    if local is not None:
        return open(local, "rb")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)
