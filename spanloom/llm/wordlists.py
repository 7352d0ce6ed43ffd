"""Word lists of scripts that write no blanks: ICU's break dictionaries, as the icu4j jar of Spark holds them."""

from __future__ import annotations

import glob
import importlib.util
import os
import struct
import zipfile
from functools import lru_cache

LISTS = "com/ibm/icu/impl/data/icudata/brkitr/{}dict.dict"

#: How a number is packed, by its lead unit: below which lead, what to take off (None: the lead is only a tag), units behind.
Bounds = tuple[tuple[int, int | None, int], ...]
VALUES: Bounds = ((0x51, 0x10, 0), (0x6C, 0x51, 1), (0x7E, 0x6C, 2), (0x7F, None, 3), (0x80, None, 4))
DELTAS: Bounds = ((0xC0, 0, 0), (0xF0, 0xC0, 1), (0xFE, 0xF0, 2), (0xFF, None, 3), (0x100, None, 4))
WIDE_VALUES: Bounds = ((0x4000, 0, 0), (0x7FFF, 0x4000, 1), (0x8000, None, 2))
WIDE_DELTAS: Bounds = ((0xFC00, 0, 0), (0xFFFF, 0xFC00, 1), (0x10000, None, 2))


class WordList:
    """The words of one dictionary, read in place: a trie of bytes or of UTF-16 units behind ICU's header."""

    def __init__(self, data: bytes) -> None:
        order = ">" if data[8] else "<"
        head = struct.unpack(f"{order}H", data[:2])[0]
        offset, _, _, total, kind, transform = struct.unpack(f"{order}6i", data[head : head + 24])
        body = data[head + offset : head + total]
        self.wide = kind & 7 == 1
        self.units = struct.unpack(f"{order}{len(body) // 2}H", body[: len(body) // 2 * 2]) if self.wide else body
        self.base = transform & 0x1FFFFF if transform & 0x7F000000 == 0x1000000 else 0

    def _number(self, at: int, size: int) -> int:
        value = 0
        for unit in self.units[at : at + size]:
            value = value << (16 if self.wide else 8) | unit
        return value

    def _packed(self, bounds: Bounds, lead: int, at: int) -> tuple[int, int]:
        """The number that begins with unit ``lead`` and where reading goes on."""
        least, size = next((least, size) for most, least, size in bounds if lead < most)
        upper = 0 if least is None else lead - least
        return upper << (16 if self.wide else 8) * size | self._number(at, size), at + size

    def _value(self, lead: int, at: int) -> tuple[int, int]:
        return self._packed(WIDE_VALUES if self.wide else VALUES, lead, at)

    def _delta(self, at: int) -> tuple[int, int]:
        return self._packed(WIDE_DELTAS if self.wide else DELTAS, self.units[at], at + 1)

    def stops(self, run: str, begin: int) -> list[int]:
        """Where the words that begin at ``begin`` of ``run`` end."""
        found: list[int] = []
        units, linear, most = self.units, 0x30 if self.wide else 0x10, 0x40 if self.wide else 0x20
        at, here, size = 0, begin, len(run)
        node = -1
        while True:
            if node < 0:
                node, at = units[at], at + 1
            if node >= most:
                found.append(here)
                if node & (0x8000 if self.wide else 1):
                    return found
                if self.wide:
                    at += 0 if node < 0x4040 else 1 if node < 0x7FC0 else 2
                    node &= 0x3F
                else:
                    at = self._value(node >> 1, at)[1]
                    node = -1
                continue
            if here >= size:
                return found
            if node >= linear:
                for unit in units[at : at + node - linear + 1]:
                    if here >= size or ord(run[here]) - self.base != unit:
                        return found
                    here += 1
                at += node - linear + 1
                node = -1
                continue
            unit = ord(run[here]) - self.base
            if node == 0:
                node, at = units[at], at + 1
            length = node + 1
            while length > 5:
                above, at = unit >= units[at], at + 1
                delta, after = self._delta(at)
                at, length = (after, length - (length >> 1)) if above else (after + delta, length >> 1)
            here += 1
            while length > 1:
                key, lead = units[at], units[at + 1]
                value, after = self._value(lead & 0x7FFF if self.wide else lead >> 1, at + 2)
                if key == unit:
                    if lead & (0x8000 if self.wide else 1):
                        return [*found, here]
                    at = after + value
                    break
                at, length = after, length - 1
            else:
                if units[at] != unit:
                    return found
                at += 1
            node = -1


@lru_cache(None)
def word_list(name: str) -> WordList:
    """The list ``thai``, ``lao``, ``khmer``, ``burmese`` or ``cj``."""
    homes = [os.environ.get("SPARK_HOME", ""), *(importlib.util.find_spec("pyspark").submodule_search_locations or [])]
    jars = [jar for home in homes if home for jar in sorted(glob.glob(f"{home}/jars/icu4j-*.jar"))]
    if not jars:
        raise FileNotFoundError(f"no icu4j jar, which has the word list {name}, in {homes}")
    with zipfile.ZipFile(jars[0]) as jar:
        return WordList(jar.read(LISTS.format(name)))
