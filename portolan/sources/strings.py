"""The shared strings of a workbook."""

from __future__ import annotations

from array import array
from collections.abc import Iterable


class Strings:
    """Texts by number: their UTF-8 in one buffer, and where each ends."""

    def __init__(self, texts: Iterable[str]):
        self.data, self.ends = bytearray(), array("Q", [0])
        for text in texts:
            self.data += text.encode("utf-8", "surrogatepass")
            self.ends.append(len(self.data))

    def __getitem__(self, i: int) -> str:
        if not 0 <= i < len(self.ends) - 1:
            raise ValueError(f"the workbook has no shared string {i}")
        return self.data[self.ends[i] : self.ends[i + 1]].decode("utf-8", "surrogatepass")
