"""Array files in the folder that all machines share, written whole and mapped into memory."""

from __future__ import annotations

import json
import os
import shutil
import struct
import tempfile
import uuid

import numpy as np

from corvane.llm.common import local_path


class ArrayStore:
    """One folder of array files, by name; a file holds one or more named arrays behind a short header.

    On a file system that is mounted everywhere the files are mapped where they lie. In another store they are written
    through its own file system and copied to a scratch folder for as long as the reader lives. A reader is given the sizes
    of all files: one that is missing or cut is an error, and a name that was never written has no arrays.
    """

    #: Files that a reader keeps mapped at a time.
    MOST_OPEN = 8000

    def __init__(self, uri: str, files: dict[str, int] | None = None):
        self.uri, self.local, self.files = uri, local_path(uri), files
        self._scratch: str | None = None
        self._open: dict[str, dict[str, np.ndarray]] = {}

    def _remote(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def write_all(self, name: str, arrays: dict[str, np.ndarray]) -> None:
        """Write under a name of its own first, so a retried or doubled task leaves one whole file."""
        arrays = {k: np.ascontiguousarray(a) for k, a in arrays.items()}
        head, at = {}, 0
        for k, a in arrays.items():
            head[k] = (a.dtype.str, at, len(a))
            at += -(-a.nbytes // 8) * 8
        text = json.dumps(head).encode()
        text += b" " * (-(len(text) + 8) % 8)
        draft = f"{name}.{uuid.uuid4().hex}"

        def fill(out) -> None:
            out.write(struct.pack("<Q", len(text)) + text)
            for a in arrays.values():
                out.write(a.tobytes() + b"\0" * (-a.nbytes % 8))

        if self.local is not None:
            os.makedirs(self.local, exist_ok=True)
            with open(f"{self.local}/{draft}", "wb") as out:
                fill(out)
            os.replace(f"{self.local}/{draft}", f"{self.local}/{name}")
            return
        system, root = self._remote()
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{draft}") as out:
            fill(out)
        system.move(f"{root}/{draft}", f"{root}/{name}")

    def sizes(self) -> dict[str, int]:
        """Bytes of each finished file; drafts of lost tasks are left out."""
        from pyarrow import fs

        system, root = self._remote() if self.local is None else (fs.LocalFileSystem(), self.local)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return {i.base_name: i.size for i in found if i.is_file and "." not in i.base_name}

    def read_all(self, name: str) -> dict[str, np.ndarray] | None:
        """The arrays of a file, mapped; None for a name that was never written."""
        if name in self._open:
            return self._open[name]
        size = self.files.get(name) if self.files is not None else None
        if self.files is not None and size is None:
            return None
        if self.local is None:
            self._scratch = self._scratch or tempfile.mkdtemp(prefix="corvane-map-")
            path = f"{self._scratch}/{name}"
            system, root = self._remote()
            with system.open_input_stream(f"{root}/{name}") as src, open(path, "wb") as out:
                shutil.copyfileobj(src, out)
        else:
            path = f"{self.local}/{name}"
        if not os.path.exists(path) or size is not None and os.path.getsize(path) != size:
            raise FileNotFoundError(f"{self.uri}/{name} is missing or cut")
        whole = np.asarray(np.memmap(path, dtype=np.uint8, mode="r"))
        (n,) = struct.unpack("<Q", whole[:8].tobytes())
        head = json.loads(whole[8:8 + n].tobytes())
        base = 8 + n
        arrays = {k: whole[base + at:base + at + count * np.dtype(kind).itemsize].view(kind) for k, (kind, at, count) in head.items()}
        if len(self._open) >= self.MOST_OPEN:
            self._open.clear()
        self._open[name] = arrays
        return arrays

    def close(self) -> None:
        self._open.clear()
        if self._scratch:
            shutil.rmtree(self._scratch, ignore_errors=True)
            self._scratch = None
