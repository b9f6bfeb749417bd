"""Failures a caller can tell apart. Each has a stable status number and text."""

from __future__ import annotations


class WorldError(Exception):
    """Base of all failures; ``status`` is the number and ``text`` the standing message of the kind."""

    status, text = 1, "failed"

    def __init__(self, detail: str = ""):
        super().__init__(f"{self.text}: {detail[:256]}" if detail else self.text)
        self.detail = detail[:256]


def _kind(name: str, status: int, text: str) -> type[WorldError]:
    return type(name, (WorldError,), {"status": status, "text": text, "__doc__": text})


InvalidArgument = _kind("InvalidArgument", 2, "invalid argument")
NotFound = _kind("NotFound", 3, "not found")
BufferTooSmall = _kind("BufferTooSmall", 4, "buffer too small")
Busy = _kind("Busy", 5, "busy")
Corrupt = _kind("Corrupt", 6, "corrupt data")
NeedsRecovery = _kind("NeedsRecovery", 7, "needs recovery")
NeedsMigration = _kind("NeedsMigration", 8, "needs migration")
UnsupportedVersion = _kind("UnsupportedVersion", 9, "unsupported version")
UnsupportedCompression = _kind("UnsupportedCompression", 10, "unsupported compression")
BatchOrder = _kind("BatchOrder", 11, "batch id out of order")
BatchTooLarge = _kind("BatchTooLarge", 12, "batch too large")
IndexFull = _kind("IndexFull", 13, "too many keys in a region")
RangeTooLarge = _kind("RangeTooLarge", 14, "range covers too many regions")
RegionMismatch = _kind("RegionMismatch", 15, "records of more than one region")
KeyOrder = _kind("KeyOrder", 16, "keys out of order or repeated")
Mismatch = _kind("Mismatch", 17, "contents differ")
Exists = _kind("Exists", 18, "destination exists")
Closed = _kind("Closed", 19, "closed")
Conflict = _kind("Conflict", 20, "another writer committed first")

STATUSES = {c.status: c.text for c in WorldError.__subclasses__()} | {0: "ok", 1: WorldError.text}


def status_message(status: int) -> str:
    return STATUSES.get(status, "unknown status")
