"""Set-up of Python workers, done where this is imported in one; the driver's process is left as it is."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark import TaskContext

if TaskContext.get() is not None:
    # arrays of a megabyte or more go back to the system when they are freed, as an executor has several workers
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
