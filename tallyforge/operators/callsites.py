"""Call sites in source texts: marked names on lines of code that ships.

A text is read by a small machine: code, a line comment, a block comment (which nests or
not), a string. Comments become blanks, so lines keep their numbers; strings stay, as
addresses stand in them. Items behind a test mark go with their whole braces.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Languages whose block comments nest, and others.
NESTED, FLAT = "nested", "flat"
_CODE = {
    FLAT: re.compile(r"""(?P<line>//[^\n]*)|(?P<block>/\*)|(?P<text>"(?:\\[\s\S]|[^"\\\n])*"?|'(?:\\[\s\S]|[^'\\\n])*'?|`(?:\\[\s\S]|[^`\\])*`?)|(?P<brace>[{}])"""),
    NESTED: re.compile(r"""(?P<line>//[^\n]*)|(?P<block>/\*)|(?P<text>\br(?P<hash>\#*)"[\s\S]*?(?:"(?P=hash)|\Z)|"(?:\\[\s\S]|[^"\\])*"?|'(?:\\[^\n']{1,10}|\\'|[^'\\\n])')|(?P<brace>[{}])"""),
}
_COMMENT = {FLAT: re.compile(r"\*/"), NESTED: re.compile(r"/\*|\*/")}
_ADDRESS = re.compile(r"""https?://[^\s"'`<>)]+""")
TEST_MARK = "#[cfg(test)]"


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def shipped(source: str, syntax: str = FLAT, test_mark: str = TEST_MARK) -> str:
    """The source with comments and test-only items blanked, line by line as long as before.
    What isn't closed goes on to the end."""
    out, braces, strings = [], [], []
    at, end = 0, len(source)
    while at < end:
        m = _CODE[syntax].search(source, at)
        if m is None:
            out.append(source[at:])
            break
        out.append(source[at : m.start()])
        kind, at = m.lastgroup if m.lastgroup != "hash" else "text", m.end()
        if kind == "line":
            out.append(_blank(m[0]))
        elif kind == "block":
            depth = 1
            while depth and (c := _COMMENT[syntax].search(source, at)):
                depth, at = depth - 1 if c[0] == "*/" else depth + 1, c.end()
            at = end if depth else at
            out.append(_blank(source[m.start() : at]))
        else:
            out.append(m[0])
            (braces if kind == "brace" else strings).append(m.start())
            if kind == "text":
                strings.append(m.end())
    return _without_tests("".join(out), braces, strings, test_mark)


def _without_tests(code: str, braces: list[int], strings: list[int], mark: str) -> str:
    inside = lambda i: bisect_left(strings, i + 1) % 2 == 1  # noqa: E731  strings are pairs of starts and ends
    out, at = [], 0
    found = code.find(mark)
    while found >= 0:
        if found < at or inside(found):
            found = code.find(mark, found + 1)
            continue
        stop = found + len(mark)
        while (stop := code.find(";", stop)) >= 0 and inside(stop):
            stop += 1
        k = bisect_left(braces, found)
        if k < len(braces) and not 0 <= stop < braces[k]:  # an item with a body
            depth = 0
            for k in range(k, len(braces)):
                depth += 1 if code[braces[k]] == "{" else -1
                if depth <= 0:
                    break
            stop = braces[k] if depth <= 0 else len(code) - 1
        stop = len(code) if stop < 0 else stop + 1
        out += [code[at:found], _blank(code[found:stop])]
        at = stop
        found = code.find(mark, at)
    return "".join([*out, code[at:]])


def sites(sources: DataFrame, markers: Sequence[str], path: str = "path", source: str = "source", syntax: str = "syntax", test_mark: str = TEST_MARK) -> DataFrame:
    """(path, line, marker, addresses): each marked name on each shipped line of each text.

    Lines count from 1. ``syntax`` tells whether block comments nest; a null syntax is
    flat, a null source empty. Texts that repeat a path are read by themselves.
    """
    kind = dict(sources.dtypes)[path]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, lines, names, links = [], [], [], []
            for i, (text, how) in enumerate(zip(batch.column("source").to_pylist(), batch.column("syntax").to_pylist())):
                if not text or not any(m in text for m in markers):
                    continue
                for n, line in enumerate(shipped(text, how or FLAT, test_mark).split("\n"), 1):
                    for m in markers:
                        if m in line:
                            at.append(i)
                            lines.append(n)
                            names.append(m)
                            links.append(_ADDRESS.findall(line))
            yield pa.record_batch([batch.column("path").take(pa.array(at, pa.int64())), pa.array(lines, pa.int32()), pa.array(names, pa.string()), pa.array(links, pa.list_(pa.string()))], ["path", "line", "marker", "addresses"])

    rows = sources.select(F.col(path).alias("path"), F.col(source).cast("string").alias("source"), F.col(syntax).cast("string").alias("syntax"))
    return rows.mapInArrow(run, f"path {kind}, line int, marker string, addresses array<string>")
