"""The first record of a CSV file, from no more of its bytes than needed."""

from __future__ import annotations

import re
from collections.abc import Iterator

# Bytes of a file that are read at a time until its first record is whole.
HEADER_BYTES = 1 << 14


def first_record(parts: Iterator[bytes]) -> str:
    """The first record that isn't blank of a file's bytes, which are taken no further than needed."""
    held, ended = b"", False
    while True:
        part = next(parts, b"")
        held, ended = held + part, not part
        text = held.decode("utf-8", "replace")
        lines = re.split("\r\n|\n|\r", text)
        whole = lines if ended else lines[:-1]
        record: list[str] = []
        for line in whole:
            if not record and not line.strip():
                continue
            record.append(line)
            joined = "\n".join(record)
            if not is_open(joined):
                return joined
        if ended:
            # a quote that is never closed ends with its line
            return record[0] if record else ""


def is_open(text: str) -> bool:
    """Whether a quoted cell goes on after the text; a quote opens only where a cell begins."""
    inside, at_start, i = False, True, 0
    while i < len(text):
        c = text[i]
        if inside and c == '"' and text[i + 1 : i + 2] == '"':
            i += 1
        elif inside and c == '"':
            inside = False
        elif not inside and at_start and c == '"':
            inside = True
        at_start = not inside and c == ","
        i += 1
    return inside
