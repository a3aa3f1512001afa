"""Content fingerprints as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 8 * 1024 * 1024
MODES = ("sha1_quick", "sha1_full", "size_only")


def fingerprint(content, size, mode: str = "sha1_quick", chunk: int = CHUNK) -> Column:
    """Fingerprint of a binary column that is already in the table.

    For files, use ``sources.files.fingerprint_files``: it reads only the first
    and last chunk of each file and never loads a whole one.
    """
    data = (F.col(content) if isinstance(content, str) else content).cast("binary")
    n = F.col(size) if isinstance(size, str) else size
    text = n.cast("string")
    if mode == "size_only":
        return F.concat(F.lit("SIZE:"), text)
    if mode == "sha1_full":
        return F.concat(F.lit("SHA1:"), F.sha1(data))
    if mode == "sha1_quick":
        head = F.substring(data, 1, chunk)
        last = F.substring(data, F.greatest(n - chunk, F.lit(0)).cast("int") + 1, F.lit(chunk))
        tail = F.when(n > chunk, last).otherwise(F.lit(b""))
        return F.concat(F.lit("QSHA1:"), F.sha1(F.concat(head, tail, text.cast("binary"))))
    raise ValueError(f"unknown fingerprint mode: {mode}")


def short_digest(content) -> Column:
    """First 12 hex digits of the SHA-256."""
    data = (F.col(content) if isinstance(content, str) else content).cast("binary")
    return F.substring(F.sha2(data, 256), 1, 12)
