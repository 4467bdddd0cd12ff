"""Sheets of binary workbooks (.xls, the format of 1997 to 2003), for the `archive` data source.

Such a file is a compound file: chains of sectors, of which one is the workbook's stream of records. The chain is followed and records are read one at a
time, so a task holds the sector table (four bytes for each sector), the shared strings as packed UTF-8, and a row. A sheet has 65,536 rows at most.

Values are what the same cells of an .xlsx sheet give: numbers in their shortest form, True and False, a formula's last result, an error's name. Older formats
and encrypted workbooks are a ValueError.
"""

from __future__ import annotations

import io
import struct
from array import array
from collections.abc import Iterator

from portolan.sources.strings import Strings

SIGNATURE = bytes.fromhex("d0cf11e0a1b11ae1")
_LAST = 0xFFFFFFFA  # sector numbers from here on are marks
# Record types of the format, and its error codes.
BOF, EOF, CONTINUE, WINDOW1, BOUNDSHEET, SST, FILEPASS = 0x809, 0x0A, 0x3C, 0x3D, 0x85, 0xFC, 0x2F
LABELSST, NUMBER, RK, MULRK, LABEL, RSTRING, BOOLERR, FORMULA, STRING = 0xFD, 0x203, 0x27E, 0xBD, 0x204, 0xD6, 0x205, 0x06, 0x207
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}


class Chain(io.RawIOBase):
    """A stream whose pieces of equal size lie anywhere in a file."""

    def __init__(self, file: io.BufferedIOBase, places: array, piece: int, size: int):
        self.file, self.places, self.piece, self.size, self.at = file, places, piece, min(size, len(places) * piece), 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.size}[whence]
        return self.at

    def readinto(self, buffer) -> int:  # noqa: ANN001
        within = self.at % self.piece
        n = min(len(buffer), self.piece - within, self.size - self.at)
        if n <= 0:
            return 0
        self.file.seek(self.places[self.at // self.piece] + within)
        found = self.file.read(n)
        buffer[: len(found)] = found
        self.at += len(found)
        return len(found)


def _numbers(data: bytes) -> tuple[int, ...]:
    return struct.unpack(f"<{len(data) // 4}I", data[: len(data) // 4 * 4])


def _chain(links: array, first: int) -> array:
    """The numbers of a chain's sectors."""
    found = array("Q")
    while first < _LAST:
        if first >= len(links) or len(found) > len(links):
            raise ValueError("the workbook's sector chain is broken")
        found.append(first)
        first = links[first]
    return found


def _stream(file: io.BufferedIOBase) -> Chain:
    """The workbook's records."""
    head = file.read(512)
    if head[:8] != SIGNATURE:
        raise ValueError("not a binary workbook")
    size, small = (1 << x for x in struct.unpack_from("<HH", head, 30))
    first_entry, cutoff, first_small, more = (struct.unpack_from("<I", head, at)[0] for at in (48, 56, 60, 68))

    def sector(n: int) -> bytes:
        file.seek((n + 1) * size)
        return file.read(size)

    tables, seen = [n for n in _numbers(head[76:512]) if n < _LAST], 0
    while more < _LAST:  # large files go on elsewhere with the list of their sector tables
        *named, more = _numbers(sector(more))
        tables += [n for n in named if n < _LAST]
        seen += 1
        if seen > 1 << 16:
            raise ValueError("the workbook's sector chain is broken")
    links = array("I")
    for n in tables:
        links.extend(_numbers(sector(n)))
    entries = b"".join(sector(n) for n in _chain(links, first_entry))
    streams, root = {}, (_LAST, 0)
    for at in range(0, len(entries), 128):
        length, kind = struct.unpack_from("<HB", entries, at + 64)
        name = entries[at : at + max(0, length - 2)].decode("utf-16-le", "replace")
        place = struct.unpack_from("<II", entries, at + 116)
        if kind == 5:
            root = place
        elif kind == 2:
            streams[name.lower()] = place
    if "workbook" not in streams:
        raise ValueError("the file has no workbook of the format of 1997 or later")
    first, length = streams["workbook"]
    if length >= cutoff:
        return Chain(file, array("Q", [(n + 1) * size for n in _chain(links, first)]), size, length)
    # short streams are parts of the root's
    whole, short = _chain(links, root[0]), array("I")
    for n in _chain(links, first_small):
        short.extend(_numbers(sector(n)))
    return Chain(file, array("Q", [(whole[n * small // size] + 1) * size + n * small % size for n in _chain(short, first)]), small, length)


def records(stream: io.BufferedIOBase) -> Iterator[tuple[int, list[bytes]]]:
    """Records of a part of the stream, up to its end: type, and contents with those of the records that continue it."""
    kind, parts = None, []
    while len(head := stream.read(4)) == 4:
        this, length = struct.unpack("<HH", head)
        data = stream.read(length)
        if this == CONTINUE:
            parts.append(data)
            continue
        if kind is not None:
            yield kind, parts
        kind, parts = this, [data]
        if this == EOF:
            break
    if kind is not None:
        yield kind, parts


class _Texts:
    """Reads strings from a record that may go on in others."""

    def __init__(self, parts: list[bytes], at: int):
        self.parts, self.n, self.at = parts, 0, at

    def _next(self) -> bool:
        while self.n < len(self.parts) and self.at >= len(self.parts[self.n]):
            self.n, self.at = self.n + 1, self.at - len(self.parts[self.n])
        return self.n < len(self.parts)

    def _take(self, form: str) -> int:
        self._next()
        (found,) = struct.unpack_from(form, self.parts[self.n], self.at)
        self.at += struct.calcsize(form)
        return found

    def one(self) -> str:
        left, flags = self._take("<H"), self._take("<B")
        skipped = 4 * self._take("<H") if flags & 8 else 0
        skipped += self._take("<I") if flags & 4 else 0
        wide, out = flags & 1, []
        while left:
            begins = self.at >= len(self.parts[self.n])
            if not self._next():
                raise ValueError("a string of the workbook is cut off")
            if begins:  # characters that go on in another record say anew how wide they are
                wide = self._take("<B") & 1
            data = self.parts[self.n][self.at : self.at + (left << wide)]
            out.append(data.decode("utf-16-le", "surrogatepass") if wide else data.decode("latin-1"))
            self.at += len(data)
            left -= len(data) >> wide
            if not data:
                raise ValueError("a string of the workbook is cut off")
        self.at += skipped
        return "".join(out)

    def all(self) -> Iterator[str]:
        while self._next():
            yield self.one()


def _number(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def _packed(x: int) -> float:
    """A number of 30 bits and two flags: whole or the upper part of a double, and whether it is in hundredths."""
    value = float((x - (x >> 31 << 32)) >> 2) if x & 2 else struct.unpack("<d", struct.pack("<II", 0, x & ~3 & 0xFFFFFFFF))[0]
    return value / 100 if x & 1 else value


def _named(code: int, error: int) -> str:
    return ERRORS.get(code, "#N/A") if error else "True" if code else "False"


class Workbook:
    """An open .xls file: its sheets by name, and the one that was open when it was saved."""

    def __init__(self, file: io.BufferedIOBase):
        self.file, self.stream = file, io.BufferedReader(_stream(file), 1 << 16)
        self.sheets: dict[str, int] = {}
        active, shown = 0, []
        for kind, parts in records(self.stream):
            if kind == BOF and struct.unpack_from("<H", parts[0])[0] != 0x600:
                raise ValueError("the workbook is older than the format of 1997")
            if kind == FILEPASS:
                raise ValueError("the workbook is encrypted")
            if kind == WINDOW1:
                (active,) = struct.unpack_from("<H", parts[0], 10)
            if kind == BOUNDSHEET:
                place, _, what, n, wide = struct.unpack_from("<IBBBB", parts[0])
                name = parts[0][8 : 8 + (n << (wide & 1))].decode("utf-16-le" if wide & 1 else "latin-1", "replace")
                shown.append(name)
                if what == 0:  # not a chart
                    self.sheets[name] = place
        if not self.sheets:
            raise ValueError("the workbook has no sheet")
        self.active = shown[active] if active < len(shown) and shown[active] in self.sheets else next(iter(self.sheets))

    def __enter__(self) -> Workbook:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()

    def namelist(self) -> list[str]:
        return list(self.sheets)

    def _strings(self) -> Strings:
        self.stream.seek(0)
        return Strings(text for kind, parts in records(self.stream) if kind == SST for text in _Texts(parts, 8).all())

    def rows(self, name: str) -> Iterator[list[str | None]]:
        """Rows of a sheet; those without cells are left out."""
        strings, row, cells = self._strings(), -1, []
        self.stream.seek(self.sheets[name])
        waiting = None  # the place of a formula whose text comes next
        depth = 0
        for kind, parts in records_of_sheet(self.stream):
            if kind == BOF:
                depth += 1
            elif kind == EOF:
                depth -= 1
            if depth != 1:  # a chart within the sheet
                continue
            data, found = parts[0], []
            if kind == LABELSST:
                found = [strings[struct.unpack_from("<I", data, 6)[0]]]
            elif kind == NUMBER:
                found = [_number(struct.unpack_from("<d", data, 6)[0])]
            elif kind == RK:
                found = [_number(_packed(struct.unpack_from("<I", data, 6)[0]))]
            elif kind == MULRK:
                found = [_number(_packed(struct.unpack_from("<I", data, at)[0])) for at in range(6, len(data) - 2, 6)]
            elif kind in (LABEL, RSTRING):
                found = [_Texts(parts, 6).one()]
            elif kind == BOOLERR:
                found = [_named(data[6], data[7])]
            elif kind == FORMULA:
                if data[12:14] == b"\xff\xff":
                    found = [None if data[6] in (0, 3) else _named(data[8], data[6] == 2)]
                    waiting = data[:4] if data[6] == 0 else None
                else:
                    found = [_number(struct.unpack_from("<d", data, 6)[0])]
            elif kind == STRING and waiting is not None:
                data, found, waiting = waiting, [_Texts(parts, 0).one()], None
            if not found:
                continue
            at, column = struct.unpack_from("<HH", data)
            if at != row:
                if at < row:
                    raise ValueError("the sheet's rows are out of order")
                if cells:
                    yield cells
                row, cells = at, []
            cells += [None] * (column + len(found) - len(cells))
            cells[column : column + len(found)] = found
        if cells:
            yield cells


def records_of_sheet(stream: io.BufferedIOBase) -> Iterator[tuple[int, list[bytes]]]:
    """Records of a sheet with all that is within it, up to the sheet's own end."""
    depth = 0
    while True:
        last = None
        for kind, parts in records(stream):
            depth += kind == BOF
            last = kind
            yield kind, parts
        depth -= last == EOF
        if last != EOF or depth <= 0:
            return
