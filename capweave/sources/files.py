"""Paths on any Hadoop file system: listing, small files, atomic publication."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import SparkSession

TEXT_NAME = re.compile(r"(\.cdxj?(\.gz)?|cdx-\d+\.gz)$", re.I)
PACKED_NAME = re.compile(r"\.parquet$")


@dataclass(frozen=True, order=True)
class FileInfo:
    path: str
    size: int
    modified: int = 0
    is_dir: bool = False

    @property
    def name(self) -> str:
        return self.path.rstrip("/").rpartition("/")[2]


class Files:
    """Driver-side file access through Hadoop, so remote stores work like local ones."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def _info(self, status) -> FileInfo:
        return FileInfo(status.getPath().toString(), status.getLen(), status.getModificationTime(), status.isDirectory())

    def uri(self, path: str) -> str:
        """The path as a row's metadata name it, less its scheme."""
        return re.sub(r"^[a-z0-9]+:/*", "/", self.jvm.org.apache.hadoop.fs.Path(path).toUri().toString())

    def glob(self, pattern: str) -> list[FileInfo]:
        fs, p = self._at(pattern)
        found = fs.globStatus(p)
        return [self._info(s) for s in (found or [])]

    def walk(self, path: str) -> list[FileInfo]:
        """All files below a folder."""
        fs, p = self._at(path)
        out, it = [], fs.listFiles(p, True)
        while it.hasNext():
            out.append(self._info(it.next()))
        return sorted(out)

    def children(self, path: str) -> list[FileInfo]:
        fs, p = self._at(path)
        return sorted(self._info(s) for s in fs.listStatus(p))

    def info(self, path: str) -> FileInfo | None:
        fs, p = self._at(path)
        return self._info(fs.getFileStatus(p)) if fs.exists(p) else None

    def exists(self, path: str) -> bool:
        return self.info(path) is not None

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str, force: bool = True) -> None:
        self.write_bytes(path, text.encode(), force)

    def write_bytes(self, path: str, data: bytes, force: bool = True) -> None:
        """The whole or nothing: written beside its place and renamed."""
        fs, p = self._at(path)
        if fs.exists(p) and not force:
            raise FileExistsError(path)
        temp = self.jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
        out = fs.create(temp, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        self.rename(f"{path}.tmp", path, force)

    def rename(self, source: str, target: str, force: bool = False) -> None:
        fs, p = self._at(source)
        q = self.jvm.org.apache.hadoop.fs.Path(target)
        if fs.exists(q):
            if not force:
                raise FileExistsError(target)
            fs.delete(q, True)
        if not fs.rename(p, q):
            raise OSError(f"can't rename {source} to {target}")

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); one of our own only on a single machine."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_to and (got := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        set_to = got.get()
    if not set_to:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_to = "/tmp/capweave-shared"
    return set_to


def _is_packed_dir(files: Files, path: str) -> bool:
    return any(PACKED_NAME.search(f.name) and f.name.startswith("part-") for f in files.children(path) if not f.is_dir)


def expand(spark: SparkSession, *paths: str) -> tuple[str, list[str]]:
    """(text | packed, sorted unique paths) of files, folders and globs.

    A named file must be an index file; folders and globs skip what is none. One kind only: a folder with both is an error.
    """
    files, text, packed = Files(spark), set(), set()

    def take(info: FileInfo, explicit: bool) -> None:
        if info.is_dir:
            if PACKED_NAME.search(info.name) or _is_packed_dir(files, info.path):
                packed.add(info.path)
                return
            for f in files.walk(info.path):
                inside = re.match(r"(.*?\.parquet)/", f.path[len(info.path) :].lstrip("/"))
                if inside:
                    packed.add(f"{info.path.rstrip('/')}/{inside[1]}")
                elif not f.name.startswith(("_", ".")):
                    take(f, False)
        elif TEXT_NAME.search(info.name):
            text.add(info.path)
        elif PACKED_NAME.search(info.name):
            packed.add(info.path)
        elif explicit:
            raise ValueError(f"not an index file: {info.path}")

    for p in paths:
        exact = None if re.search(r"[*?\[{]", p) else files.info(p)
        found = [exact] if exact else files.glob(p)
        if not found:
            raise FileNotFoundError(f"no index files match {p}")
        for info in found:
            take(info, exact is not None)
    if text and packed:
        raise ValueError("text and packed files can't form one index")
    if not text and not packed:
        raise FileNotFoundError(f"no index files in {', '.join(paths)}")
    return ("text", sorted(text)) if text else ("packed", sorted(packed))
