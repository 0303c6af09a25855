"""Text inside binary files: printable runs, PDF streams, image metadata, archives, key structure.

The parsers are pure functions on bytes; ``extracted_text`` applies them in Arrow batches, one file in memory at a time.
"""

from __future__ import annotations

import base64
import io
import re
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Bytes of one archive entry that are unpacked at most.
MAX_ENTRY = 5 * 1024 * 1024


def strings(data: bytes, least: int = 6) -> list[str]:
    """Printable ASCII runs and UTF-16LE runs."""
    narrow = [m.group().decode("ascii") for m in re.finditer(rb"[\x20-\x7e]{%d,}" % least, data)]
    return narrow + [m.group().decode("utf-16le") for m in re.finditer(rb"(?:[\x20-\x7e]\x00){%d,}" % least, data)]


def pdf_text(data: bytes) -> str:
    """Literals of a PDF's content streams, deflated ones unpacked."""
    parts = [data]
    for m in re.finditer(rb"stream\r?\n(.*?)endstream", data, re.S):
        try:
            parts.append(zlib.decompressobj().decompress(m[1], 50 * 1024 * 1024))
        except zlib.error:
            continue
    return "\n".join(x.decode("latin-1") for p in parts for x in re.findall(rb"\(((?:[^()\\]|\\.)*)\)", p))


def exif_strings(data: bytes) -> list[str]:
    """ASCII tags of a JPEG's first image directory."""
    at = data.find(b"Exif\x00\x00")
    if data[:2] != b"\xff\xd8" or at < 0:
        return []
    tiff = data[at + 6 :]
    order = "<" if tiff[:2] == b"II" else ">"
    out: list[str] = []
    try:
        (first,) = struct.unpack_from(order + "I", tiff, 4)
        (count,) = struct.unpack_from(order + "H", tiff, first)
        for n in range(min(count, 512)):
            _, kind, size, value = struct.unpack_from(order + "HHII", tiff, first + 2 + 12 * n)
            if kind == 2:
                raw = tiff[value : value + size] if size > 4 else struct.pack(order + "I", value)[:size]
                out.append(raw.rstrip(b"\x00").decode("latin-1"))
    except struct.error:
        pass
    return out


def archive_entries(data: bytes, max_entry: int = MAX_ENTRY) -> Iterator[tuple[str, bytes]]:
    """Entries of zip and tar archives; entries whose path leaves the archive are skipped, large ones cut off."""
    if data[:2] == b"PK":
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for i in z.infolist():
                    if not i.is_dir() and not (i.filename.startswith("/") or ".." in i.filename.split("/")):
                        with z.open(i) as f:
                            yield i.filename, f.read(max_entry)
        except (zipfile.BadZipFile, RuntimeError, zlib.error):
            return
    else:
        try:
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                for i in t:
                    if i.isfile() and not (i.name.startswith("/") or ".." in i.name.split("/")):
                        yield i.name, t.extractfile(i).read(max_entry)
        except (tarfile.TarError, EOFError, zlib.error):
            return


def env_pairs(text: str) -> list[tuple[int, str, str]]:
    """(line, key, value) of a .env file."""
    out = []
    for n, line in enumerate(text.splitlines(), 1):
        m = re.match(r"\s*(?:export\s+)?([A-Za-z_][\w.]*)\s*=\s*(.*?)\s*$", line)
        if m and not line.lstrip().startswith("#"):
            out.append((n, m[1], m[2].strip("\"'")))
    return out


def der_modulus_bits(pem_body: str) -> int | None:
    """Bits of the first large integer of a DER structure (an RSA modulus), None if it isn't one."""
    try:
        data = base64.b64decode(re.sub(r"\s", "", pem_body), validate=True)
    except ValueError:
        return None

    def element(at: int) -> tuple[int, int, int] | None:
        if at + 2 > len(data):
            return None
        size, head = data[at + 1], 2
        if size & 0x80:
            n = size & 0x7F
            size, head = int.from_bytes(data[at + 2 : at + 2 + n]), 2 + n
        return (data[at], at + head, size) if at + head + size <= len(data) else None

    outer = element(0)
    if not outer or outer[0] != 0x30:
        return None
    at = outer[1]
    while (e := element(at)) is not None:
        if e[0] == 0x02 and e[2] > 32:
            return int.from_bytes(data[e[1] : e[1] + e[2]]).bit_length()
        at = e[1] + e[2]
    return None


def extracted_text(files: DataFrame) -> DataFrame:
    """file_path, entry, text of binary files (file_path, content binary): PDF, JPEG, archives, else printable runs."""

    def of(path: str, data: bytes, depth: int = 0) -> Iterator[tuple[str, str]]:
        low = path.lower()
        if low.endswith(".pdf"):
            yield "", pdf_text(data)
        elif low.endswith((".jpg", ".jpeg")):
            yield "", "\n".join(exif_strings(data))
        elif low.endswith((".zip", ".jar", ".apk", ".ipa", ".tar", ".tgz", ".tar.gz")) and depth < 2:
            for name, body in archive_entries(data):
                for inner, text in of(name, body, depth + 1):
                    yield f"{name}{'!' + inner if inner else ''}", text
        else:
            yield "", "\n".join(strings(data))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, data in zip(b["file_path"], b["content"], strict=True):
                if data is not None:
                    yield pd.DataFrame([(path, e, t) for e, t in of(path, bytes(data))], columns=["file_path", "entry", "text"])

    return files.select("file_path", "content").mapInPandas(run, "file_path string, entry string, text string")
