"""Feature collections of any size, cut by byte ranges: a first pass tells what is open where a range begins, a second reads its features.

Whether a byte lies within a string, and in which objects and arrays, depends on all before it. So every range is summed up
twice, as if it began outside a string and as if inside: what it closes, what it leaves open, and whether a string is open at
its end. These sums, a few bytes a range, are put together on the driver; then each range knows how it begins.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a range, and those read at once beyond its end for the feature that goes over it.
RANGE, MORE = 32 << 20, 1 << 20
STRING, OPEN_STRING, REST = re.compile(rb'"(?:[^"\\]|\\.)*"', re.DOTALL), re.compile(rb'"(?:[^"\\]|\\.)*\\?\Z', re.DOTALL), re.compile(rb'(?:[^"\\]|\\.)*"', re.DOTALL)
MARK = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]', re.DOTALL)
#: What is open where a feature begins: the collection, and its array.
BEFORE_FEATURE = "{["
DECODER = json.JSONDecoder()


class Bytes:
    """A file by a URI that pyarrow's file systems know."""

    def __init__(self, path: str):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(base)
        self.size = self.file.size()

    def border(self, at: int) -> int:
        """A place at or just after `at` that no backslash escapes."""
        k = at
        while k > 0 and self.file.read_at(1, k - 1) == b"\\":
            k -= 1
        return min(self.size, at + (at - k) % 2)

    def part(self, a: int, b: int) -> bytes:
        return self.file.read_at(b - a, a)


def summed(data: bytes, inside: bool) -> tuple[str, str, bool]:
    """Brackets that data closes before any of its own, brackets that it leaves open, and whether it ends within a string."""
    if inside:
        m = REST.match(data)
        if not m:
            return "", "", True
        data = data[m.end() :]
    data, open_string = STRING.sub(b"", data), False
    if m := OPEN_STRING.search(data):
        data, open_string = data[: m.start()], True
    marks, n = re.sub(rb"[^{}\[\]]+", b"", data), -1
    while n != len(marks):  # pairs that enclose nothing go, as long as there are any
        n = len(marks)
        marks = marks.replace(b"[]", b"").replace(b"{}", b"")
    k = next((i for i, c in enumerate(marks) if c in b"{["), len(marks))
    return marks[:k].decode(), marks[k:].decode(), open_string


def features_of(data: Bytes, a: int, b: int, stack: str, inside: bool) -> Iterator[str]:
    """Text of every object that begins in [a, b) as an element of the collection's array, read to its end beyond b if need be."""
    raw = data.part(a, b)
    end = b
    if inside:
        m = REST.match(raw)
        if not m:
            return
        a, raw = a + m.end(), raw[m.end() :]
    lead = next((i for i in range(min(4, len(raw))) if raw[i] & 0xC0 != 0x80), 0)  # a range may begin within a character
    text = raw[lead:].decode("utf-8", "ignore")
    limit, at, opened = len(text), 0, list(stack)
    while at < limit:
        if "".join(opened) == BEFORE_FEATURE:
            while at < limit and text[at] in " \t\r\n,":
                at += 1
            if at < limit and text[at] == "{":
                while True:
                    try:
                        _, stop = DECODER.raw_decode(text, at)
                        break
                    except json.JSONDecodeError:
                        if end >= data.size:
                            return  # a file that breaks off
                        end = min(data.size, end + MORE)
                        text = data.part(a, end)[lead:].decode("utf-8", "ignore")
                yield text[at:stop]
                at = stop
                continue
        m = MARK.search(text, at, limit)
        if not m:
            return
        at, c = m.end(), m[0]
        if c in "{[":
            opened.append(c)
        elif c in "}]" and opened:
            opened.pop()


def feature_texts(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """value: the text of each feature of the collections in a file or folder (.json or .geojson; a URI), `size` bytes a task.

    Elements of other arrays of the collection, and whatever isn't of type Feature, are left out. The driver keeps the sums
    of the ranges, which are as many as the files have ranges.
    """
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(path)
    one = store.get_file_info(base)
    names = [path] if one.is_file else [f"{path.rstrip('/')}/{i.base_name}" for i in sorted(store.get_file_info(fs.FileSelector(base)), key=lambda i: i.path) if i.extension in ("json", "geojson")]
    sizes = {n: Bytes(n).size for n in names}
    ranges = [(n, a, min(a + size, sizes[n])) for n in names for a in range(0, sizes[n], size)]
    if not ranges:
        return spark.createDataFrame([], "value string")
    many = spark.createDataFrame(ranges, "name string, a long, b long").repartition(len(ranges))

    def sums(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for name, a, b in pdf.itertuples(index=False):
                data = Bytes(name)
                part = data.part(data.border(a), data.border(b))
                yield pd.DataFrame([(name, a, b, *summed(part, False), *summed(part, True))], columns=["name", "a", "b", "c0", "o0", "s0", "c1", "o1", "s1"])

    found = sorted(map(tuple, many.mapInPandas(sums, "name string, a long, b long, c0 string, o0 string, s0 boolean, c1 string, o1 string, s1 boolean").collect()))
    begun, last = [], None
    for name, a, b, *both in found:
        stack, inside = ("", False) if name != last else (stack, inside)
        begun.append((name, a, b, stack, inside))
        closes, opens, inside = both[3:] if inside else both[:3]
        stack, last = stack[: max(0, len(stack) - len(closes))] + opens, name

    def read(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for name, a, b, stack, inside in pdf.itertuples(index=False):
                data, held, weight = Bytes(name), [], 0
                for text in features_of(data, data.border(a), data.border(b), stack, inside):
                    held.append(text)
                    weight += len(text)
                    if weight >= MORE:
                        yield pd.DataFrame({"value": held})
                        held, weight = [], 0
                yield pd.DataFrame({"value": held}, dtype=object)

    rows = spark.createDataFrame(begun, "name string, a long, b long, stack string, inside boolean").repartition(len(begun))
    return rows.mapInPandas(read, "value string").where(F.get_json_object("value", "$.type") == "Feature")
