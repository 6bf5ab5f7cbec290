"""Arrays of one task that may be larger than its memory."""
from __future__ import annotations

import os
import tempfile

import numpy as np

#: Bytes of an array that are kept in memory; only speed depends on it.
HELD = 4 << 20


class Spool:
    """An array made by appending: in memory up to HELD bytes, beyond that in a file without a name in the executor's
    local folder, which ``array`` maps.  Mapped pages can be given back at any time, so a task's own memory doesn't grow with them."""

    def __init__(self, dtype, width: int = 0):
        self.dtype, self.width = np.dtype(dtype), width
        self.parts: list[np.ndarray] = []
        self.held, self.file = 0, None

    def add(self, values: np.ndarray) -> None:
        part = np.ascontiguousarray(values).reshape(-1).view(np.uint8)
        if self.file is None and self.held + len(part) > HELD:
            self.file = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()).split(",")[0])
            for earlier in self.parts:
                self.file.write(earlier)
            self.parts = []
        if self.file is None:
            self.parts.append(part.copy())  # not a view of a batch that would stay for its sake
            self.held += len(part)
        else:
            self.file.write(part)

    def array(self) -> np.ndarray:
        if self.file is not None:
            self.file.flush()
            flat = np.memmap(self.file, np.uint8, "r").view(np.ndarray)
        else:
            flat = np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint8)
        flat = flat.view(self.dtype)
        return flat.reshape(-1, self.width) if self.width else flat
