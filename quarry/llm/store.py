"""Byte files in the shared folder, from driver or executors, over any store that Arrow opens."""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def make_folder(path: str) -> str:
    system, at = opened(path)
    system.create_dir(at, recursive=True)
    return path


class Writer:
    """Appends byte strings to one file and says where each landed."""

    def __init__(self, path: str):
        system, at = opened(path)
        self.path, self.at, self.out = path, 0, system.open_output_stream(at, compression=None)

    def add(self, data: bytes) -> tuple[int, int]:
        start = self.at
        self.out.write(data)
        self.at += len(data)
        return start, len(data)

    def close(self) -> None:
        self.out.close()


#: Wanted ranges are read together over gaps of up to GAP bytes, in reads of up to READ bytes.
GAP, READ = 64 << 10, 4 << 20


def coalesced(ranges: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[int]]]:
    """(from, to, which ranges) for sorted (offset, length) ranges of one file."""
    start = end = None
    inside: list[int] = []
    for k, (offset, length) in enumerate(ranges):
        if start is not None and offset - end <= GAP and max(end, offset + length) - start <= READ:
            end = max(end, offset + length)
            inside.append(k)
            continue
        if start is not None:
            yield start, end, inside
        start, end, inside = offset, offset + length, [k]
    if start is not None:
        yield start, end, inside


class Reader:
    """Byte ranges of files; the last file stays open."""

    def __init__(self) -> None:
        self.path, self.file = None, None

    def read(self, path: str, ranges: list[tuple[int, int]]) -> Iterator[tuple[int, bytes]]:
        """(which range, its bytes) for (offset, length) ranges sorted by offset."""
        if path != self.path:
            self.close()
            system, at = opened(path)
            self.path, self.file = path, system.open_input_file(at)
        for start, end, inside in coalesced(ranges):
            data = self.file.read_at(end - start, start)
            for k in inside:
                offset, length = ranges[k]
                yield k, data[offset - start : offset - start + length]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.path = self.file = None
