"""Safe reading of zip and tar archives."""

from __future__ import annotations

import io
import stat
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Bounds of one archive: members, unpacked bytes, and unpacked over packed.
MOST_MEMBERS, MOST_BYTES, MOST_RATIO = 10_000, 1 << 30, 200


class Refused(ValueError):
    """The archive may not be unpacked."""


def safe_name(name: str) -> str:
    """The member's name if it stays inside the target folder."""
    plain = name.replace("\\", "/")
    if plain.startswith("/") or (len(plain) > 1 and plain[1] == ":") or ".." in plain.split("/") or "\0" in plain:
        raise Refused("a member leaves the archive")
    return plain


def members(content: bytes, most_members: int = MOST_MEMBERS, most_bytes: int = MOST_BYTES, most_ratio: int = MOST_RATIO) -> list[tuple[str, bytes]]:
    """(name, bytes) of the regular files; every bound is checked on what is really read, not on what headers say."""
    out, total = [], 0

    def take(name: str, stream) -> None:
        nonlocal total
        data = stream.read(most_bytes - total + 1)
        total += len(data)
        if total > most_bytes or total > most_ratio * max(len(content), 1):
            raise Refused("the archive unpacks to too much")
        out.append((safe_name(name), data))
        if len(out) > most_members:
            raise Refused("the archive has too many members")

    if zipfile.is_zipfile(io.BytesIO(content)):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for info in z.infolist():
                mode = info.external_attr >> 16
                if mode and not (stat.S_ISREG(mode) or stat.S_ISDIR(mode) or stat.S_IFMT(mode) == 0):
                    raise Refused("a member is no regular file")
                safe_name(info.filename)
                if not info.is_dir():
                    with z.open(info) as stream:
                        take(info.filename, stream)
        return out
    try:
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            for info in t:
                safe_name(info.name)
                if not (info.isfile() or info.isdir()):
                    raise Refused("a member is no regular file")
                if info.isfile():
                    take(info.name, t.extractfile(info))
    except tarfile.TarError as error:
        raise Refused("neither a zip nor a tar archive") from error
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """(archive, name, content) of the files of all archives under ``path``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive, content in zip(frame["path"], frame["content"], strict=True):
                yield pd.DataFrame([(archive, n, c) for n, c in members(bytes(content))], columns=["archive", "name", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, name string, content binary")
