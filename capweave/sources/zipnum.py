"""Sparse block indexes (cluster.idx) over gzip shards: read only the members that a key range can need."""

from __future__ import annotations

import bisect
import re
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capweave.operators.match import UrlPattern
from capweave.sources.files import Files
from capweave.sources.text import parse

LINES_PER_BLOCK = 3000


@dataclass(frozen=True)
class Block:
    key: str
    filename: str
    offset: int
    length: int
    part: int | None


def parse_block(line: str) -> Block | None:
    cells = line.rstrip("\r\n").split("\t")
    if len(cells) < 4 or not (cells[2].isdigit() and cells[3].isdigit()) or (len(cells) > 4 and not re.fullmatch(r"[0-9]+", cells[4])):
        return None
    return Block(cells[0], cells[1], int(cells[2]), int(cells[3]), int(cells[4]) if len(cells) > 4 else None)


class BlockIndex:
    """The blocks of one folder's shards."""

    def __init__(self, files: Files, folder: str, shards: list[str]) -> None:
        self.folder = folder
        self.shards = {p.rpartition("/")[2]: p for p in shards}
        self.blocks = [b for line in files.read(f"{folder}/cluster.idx").split("\n") if (b := parse_block(line))]
        self.keys = [b.key for b in self.blocks]
        self.covered = {name for name, path in self.shards.items() if self._covers(name, files.info(path).size)}

    def _covers(self, name: str, size: int) -> bool:
        """Only a shard all of whose bytes are in blocks may be pruned."""
        at = 0
        for start, end in sorted((b.offset, b.offset + b.length) for b in self.blocks if b.filename == name):
            if start > at:
                return False
            at = max(at, end)
        return at >= size and at > 0

    def candidates(self, pattern: UrlPattern) -> list[Block]:
        """Blocks that may hold keys of the pattern, each once, in index order."""
        seen: dict[tuple, Block] = {}
        for low, high in pattern.key_ranges():
            first = max(bisect.bisect_left(self.keys, low) - 1, 0)
            last = bisect.bisect_left(self.keys, high) if high is not None else len(self.keys)
            for b in self.blocks[first:last]:
                if b.filename in self.covered:
                    seen.setdefault((b.filename, b.offset, b.length), b)
        return list(seen.values())


def find(spark: SparkSession, paths: list[str]) -> list[BlockIndex]:
    files, folders = Files(spark), {}
    for p in paths:
        folders.setdefault(p.rpartition("/")[0], []).append(p)
    out = [BlockIndex(files, d, own) for d, own in sorted(folders.items()) if files.exists(f"{d}/cluster.idx")]
    return [x for x in out if x.blocks]


def read_blocks(spark: SparkSession, blocks: list[tuple[str, int, Block]], strict: bool = True) -> DataFrame:
    """Captures of (path, file_ord, block): a task inflates its blocks alone."""
    rows = [(p, o, b.offset, b.length, (b.part - 1) * LINES_PER_BLOCK if b.part else 0) for p, o, b in blocks]
    table = spark.createDataFrame(rows, "source_path string, file_ord int, offset long, length long, base long").repartition(max(1, min(len(rows), 1000)))

    def inflate(batches):
        from pyarrow import fs

        for b in batches:
            for path, ord_, offset, length, base in zip(*(c.to_pylist() for c in b.columns)):
                store, name = fs.FileSystem.from_uri(path if "://" in path else "file://" + re.sub(r"^file:/*", "/", path))
                with store.open_input_file(name) as f:
                    data, out = f.read_at(length, offset), b""
                while data:
                    z = zlib.decompressobj(31)
                    out += z.decompress(data)
                    data = z.unused_data
                # lines end at line feeds alone: JSON may hold other separators
                lines = [x.decode("utf-8", "replace") for x in out.removesuffix(b"\n").split(b"\n")] if out else []
                n = len(lines)
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array([path] * n, pa.string()), pa.array([ord_] * n, pa.int32()), pa.array(range(base + 1, base + n + 1), pa.int64())], names=["value", "source_path", "file_ord", "line_number"])

    return parse(table.mapInArrow(inflate, "value string, source_path string, file_ord int, line_number long"), strict)


def pruned(spark: SparkSession, paths: list[str], pattern: UrlPattern | None, read_whole) -> DataFrame:
    """Captures of the shards: covered ones through their blocks, others whole by read_whole(paths)."""
    if pattern is None:
        return read_whole(paths)
    order = {p: i for i, p in enumerate(sorted(paths))}
    blocks, covered = [], set()
    for index in find(spark, paths):
        covered |= {index.shards[n] for n in index.covered}
        blocks += [(index.shards[b.filename], order[index.shards[b.filename]], b) for b in index.candidates(pattern)]
    rest = [p for p in paths if p not in covered]
    parts = []
    if rest:
        parts.append(read_whole(rest))
    if blocks or not rest:
        parts.append(read_blocks(spark, blocks) if blocks else read_whole(paths).limit(0))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.where(F.lit(True))
