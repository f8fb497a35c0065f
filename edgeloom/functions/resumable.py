"""SHA-256 whose state is bytes, so that one task goes on where another ended. hashlib cannot give its state away; OpenSSL, which it is built on, can."""

from __future__ import annotations

import _hashlib
import ctypes
import ctypes.util
import sys
from functools import cache

import pyarrow as pa

#: Bytes kept for OpenSSL's SHA256_CTX, which has 112 and no pointers.
ROOM = 128


@cache
def library() -> ctypes.CDLL | None:
    """OpenSSL as Python's own hashlib has it, else the system's; None if neither shows its functions."""
    for find in (lambda: getattr(_hashlib, "__file__", None), lambda: ctypes.util.find_library("crypto") if sys.platform == "linux" else None):
        try:
            found = ctypes.CDLL(name) if (name := find()) else None
            if found is not None:
                found.SHA256_Init.argtypes = (ctypes.c_void_p,)
                found.SHA256_Update.argtypes = (ctypes.c_void_p, ctypes.c_void_p, ctypes.c_size_t)
                found.SHA256_Final.argtypes = (ctypes.c_void_p, ctypes.c_void_p)
                return found
        except (OSError, AttributeError):
            continue
    return None


class Sha256:
    """A SHA-256 from its beginning, or from the state of an earlier one."""

    def __init__(self, state: bytes | None = None):
        self._to = library()
        if self._to is None:
            raise RuntimeError("OpenSSL's SHA256 functions are not found")
        self._held = ctypes.create_string_buffer(state or b"", ROOM)
        if state is None:
            self._to.SHA256_Init(self._held)

    def update(self, data: bytes | pa.Buffer) -> Sha256:
        found = data if isinstance(data, pa.Buffer) else pa.py_buffer(data)
        self._to.SHA256_Update(self._held, found.address, found.size)
        return self

    @property
    def state(self) -> bytes:
        return self._held.raw

    def hexdigest(self) -> str:
        made, end = ctypes.create_string_buffer(32), ctypes.create_string_buffer(self._held.raw, ROOM)
        self._to.SHA256_Final(made, end)
        return made.raw.hex()
