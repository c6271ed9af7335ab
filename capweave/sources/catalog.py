"""Published crawls: their list, their shards' paths, and downloads, all over an injectable fetcher."""

from __future__ import annotations

import gzip
import json
import os
import re
import shutil
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

BASE_URL = "https://data.commoncrawl.org"
LIST_URL = "https://index.commoncrawl.org/collinfo.json"


@dataclass(frozen=True)
class Crawl:
    id: str
    name: str
    from_: str | None = None
    to: str | None = None


@dataclass(frozen=True)
class Downloaded:
    path: str
    url: str
    skipped: bool


def fetch(url: str) -> bytes:
    with urllib.request.urlopen(url, timeout=60) as r:
        return r.read()


def download(url: str, target: str) -> None:
    with urllib.request.urlopen(url, timeout=60) as r, open(target, "wb") as f:
        shutil.copyfileobj(r, f)


class Catalog:
    def __init__(self, fetcher: Callable[[str], bytes] = fetch, downloader: Callable[[str, str], None] = download, base_url: str = BASE_URL, list_url: str = LIST_URL) -> None:
        self.fetcher, self.downloader, self.base_url, self.list_url = fetcher, downloader, base_url.rstrip("/"), list_url

    def crawls(self) -> list[Crawl]:
        """Newest first."""
        rows = json.loads(self.fetcher(self.list_url))
        return sorted((Crawl(r["id"], r.get("name", r["id"]), r.get("from"), r.get("to")) for r in rows), key=lambda c: c.id, reverse=True)

    def latest_crawl(self) -> Crawl:
        return self.crawls()[0]

    def index_paths(self, crawl: str, limit: int | None = None, zipnum: bool = True) -> list[str]:
        """The crawl's index shards (the first `limit`), then its block index unless zipnum is false; without a shard, nothing."""
        if not re.fullmatch(r"CC-MAIN-\d{4}-\d{2}", crawl):
            raise ValueError(f"invalid crawl: {crawl!r}")
        raw = self.fetcher(f"{self.base_url}/crawl-data/{crawl}/cc-index.paths.gz")
        text = (gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).decode()
        own = [p for p in (x.strip() for x in text.splitlines()) if re.search(rf"(^|/)collections/{crawl}/indexes/", p)]
        shards = sorted(p for p in own if re.search(r"/cdx-\d+\.gz$", p))
        shards = shards[: None if limit is None else max(0, limit)]
        return shards + [p for p in own if shards and zipnum and p.endswith("/cluster.idx")]

    def fetch_index(self, crawl: str, folder: str, limit: int | None = None, force: bool = False, zipnum: bool = True, progress: Callable[[Downloaded], None] | None = None) -> list[Downloaded]:
        """Downloads what is not there yet; a file appears only when it is whole."""
        os.makedirs(folder, exist_ok=True)
        out = []
        for p in self.index_paths(crawl, limit, zipnum):
            target, url = os.path.join(folder, os.path.basename(p)), f"{self.base_url}/{p}"
            skipped = os.path.exists(target) and not force
            if not skipped:
                temp = f"{target}.part"
                try:
                    self.downloader(url, temp)
                    os.replace(temp, target)
                finally:
                    if os.path.exists(temp):
                        os.remove(temp)
            out.append(Downloaded(target, url, skipped))
            if progress:
                progress(out[-1])
        return out
