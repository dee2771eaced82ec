"""Files of independent zstandard frames with a trailing seek table.

The layout is the public seekable format: data frames that each decompress alone, then skippable frames that every
zstandard reader passes over. A first skippable frame holds the directory (ids and token counts of the documents), the last one the seek table
with compressed size, raw size and a checksum (low 32 bits of XXH64 of the raw bytes) per data frame, and a footer.
The raw stream is the documents' token ids as little-endian unsigned 32-bit integers, cut into frames of equal raw
size; a document is an interval of the stream, so a reader decompresses only the frames that interval touches.
"""

from __future__ import annotations

import struct

import numpy as np
import xxhash
import zstandard
from pyarrow import fs

DIRECTORY_MAGIC = 0x184D2A50
TABLE_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
FRAME_BYTES = 1 << 18
_CHECKSUMS = 0x80  # descriptor bit: entries have checksums
_ENTRY = np.dtype([("packed", "<u4"), ("raw", "<u4"), ("check", "<u4")])


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class Writer:
    """Writes one file; ``add`` appends a document, ``close`` the directory and the table."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 1):
        self.out, self.frame_bytes = out, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.pending = bytearray()
        self.entries: list[tuple[int, int, int]] = []
        self.ids: list[int] = []
        self.known: list[bool] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, raw: bytes) -> None:
        self.ids.append(doc_id or 0)
        self.known.append(doc_id is not None)
        self.counts.append(len(raw) // 4)
        self.pending += raw
        while len(self.pending) >= self.frame_bytes:
            self._frame(bytes(self.pending[: self.frame_bytes]))
            del self.pending[: self.frame_bytes]

    def _frame(self, raw: bytes) -> None:
        packed = self.packer.compress(raw)
        self.out.write(packed)
        self.entries.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> tuple[int, int]:
        """Documents and tokens written."""
        if self.pending:
            self._frame(bytes(self.pending))
        n = len(self.ids)
        directory = b"".join(
            (
                struct.pack("<Q", n),
                np.array(self.ids, "<i8").tobytes(),
                np.array(self.counts, "<u8").tobytes(),
                np.array(self.known, "u1").tobytes(),
            )
        )
        body = self.packer.compress(directory)
        self.out.write(struct.pack("<II", DIRECTORY_MAGIC, len(body)) + body)
        table = np.array(self.entries, _ENTRY).tobytes() + struct.pack("<IBI", len(self.entries), _CHECKSUMS, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(table)) + table)
        return n, sum(self.counts)


class Reader:
    """Random access to one file: ``tokens(i)`` decompresses only the frames of document ``i``."""

    def __init__(self, src):
        self.src = src
        size = src.size()
        frames, descriptor, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER_MAGIC or not descriptor & _CHECKSUMS:
            raise ValueError("no seek table with checksums")
        body = frames * _ENTRY.itemsize + 9
        head = struct.unpack("<II", self._at(size - body - 8, 8))
        if head != (TABLE_MAGIC, body):
            raise ValueError("broken seek table")
        self.table = np.frombuffer(self._at(size - body, body - 9), _ENTRY)
        self.starts = np.concatenate([[0], np.cumsum(self.table["packed"], dtype=np.int64)])
        self.raw_starts = np.concatenate([[0], np.cumsum(self.table["raw"], dtype=np.int64)])
        magic, length = struct.unpack("<II", self._at(int(self.starts[-1]), 8))
        if magic != DIRECTORY_MAGIC:
            raise ValueError("no directory")
        self.unpacker = zstandard.ZstdDecompressor()
        directory = self.unpacker.decompress(self._at(int(self.starts[-1]) + 8, length))
        (n,) = struct.unpack_from("<Q", directory)
        self.ids = np.frombuffer(directory, "<i8", n, 8)
        self.counts = np.frombuffer(directory, "<u8", n, 8 + 8 * n).astype(np.int64)
        self.known = np.frombuffer(directory, "u1", n, 8 + 16 * n).astype(bool)
        self.offsets = np.concatenate([[0], np.cumsum(self.counts)])
        self._kept: tuple[int, bytes] = (-1, b"")

    def _at(self, start: int, length: int) -> bytes:
        self.src.seek(start)
        return self.src.read(length)

    def _frame(self, k: int) -> bytes:
        if self._kept[0] != k:
            raw = self.unpacker.decompress(self._at(int(self.starts[k]), int(self.table["packed"][k])))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table["check"][k]:
                raise ValueError(f"frame {k} is damaged")
            self._kept = (k, raw)
        return self._kept[1]

    def tokens(self, i: int) -> bytes:
        """The ids of document ``i`` in the file's order, as raw little-endian bytes."""
        begin, end = int(self.offsets[i]) * 4, int(self.offsets[i + 1]) * 4
        if begin == end:
            return b""
        first = int(np.searchsorted(self.raw_starts, begin, "right")) - 1
        out, k = [], first
        while begin < end:
            at = begin - int(self.raw_starts[k])
            part = self._frame(k)[at : at + end - begin]
            out.append(part)
            begin += len(part)
            k += 1
        return b"".join(out)
