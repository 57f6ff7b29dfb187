"""File type of first bytes, as functions.exprs.mime_type() has it, for use while listing."""

from siftfold.functions.exprs import MAGIC, PROBE

_MAGIC = [(bytes.fromhex(h), name) for h, name in MAGIC]
_PRINTABLE = frozenset([*range(0x20, 0x7F), 9, 10, 12, 13])


def sniffed(head: bytes) -> str | None:
    if len(head) < 4:
        return None
    for start, name in _MAGIC:
        if head.startswith(start):
            return name
    return "text/plain" if _PRINTABLE.issuperset(head[:PROBE]) else None
