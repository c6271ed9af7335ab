"""Reading text and packed indexes, block pruning, deriving, resuming, the catalogue, the command line and the stream."""

import gzip
import io
import json
import os

import pytest
from pyspark.sql import functions as F

from capweave import cli
from capweave.operators import allowlist
from capweave.operators.filters import named
from capweave.operators.match import UrlPattern
from capweave.plans import derive
from capweave.plans.derive import Plan
from capweave.schema import CaptureError, EncodeError, UnsupportedCollapse
from capweave.sources import packed, zipnum
from capweave.sources.catalog import Catalog
from capweave.sources.files import Files, expand
from capweave.sources.index import Index
from capweave.sources.text import read_text


def line(key, timestamp="20240101000000", url=None, **more):
    host, path = key.split(")", 1)
    data = {"url": url or f"https://{'.'.join(reversed(host.split(',')))}{path}", "mime": "text/html", "status": "200", "length": "10", "offset": "0", "filename": "crawl-data/CC-MAIN-2024-05/segments/1/warc/a-00000.warc.gz", **more}
    return f"{key} {timestamp} {json.dumps({k: v for k, v in data.items() if v is not None})}"


def write(path, *lines, compress=False):
    data = "".join(f"{x}\n" for x in lines).encode()
    path.write_bytes(gzip.compress(data) if compress else data)
    return str(path)


def test_cdxj_json_and_comments(spark, tmp_path):
    p = write(tmp_path / "a.cdxj", "# note", "", line("com,a)/1", extra="x", **{"mime-detected": "text/plain"}), json.dumps({"urlkey": "com,a)/2", "timestamp": "2024", "url": "http://a.com/2", "length": 7}), f"k t {json.dumps({'urlkey': 'own', 'timestamp': '1999'})}")
    got = read_text(spark, [p]).orderBy("line_number").collect()
    assert [(r["urlkey"], r["timestamp"], r["line_number"]) for r in got] == [("com,a)/1", "20240101000000", 3), ("com,a)/2", "2024", 4), ("own", "1999", 5)]
    assert got[0]["mime_detected"] == "text/plain" and got[0]["extras"] == {"extra": "x"} and got[1]["length"] == "7" and got[0]["raw"].startswith("com,a)/1 ")


def test_cdx_columns_and_headers(spark, tmp_path):
    p = write(tmp_path / "a.cdx", "com,a)/0 2023 http://a.com/0 text/html 200 D - - 5 6 f.warc.gz", " CDX N b a s", "com,a)/1 2024 http://a.com/1 404", " CDX N b q", "com,a)/2 2025 rest of line")
    got = read_text(spark, [p]).orderBy("line_number").collect()
    assert (got[0]["filename"], got[0]["redirect"], got[0]["offset"]) == ("f.warc.gz", "-", "6")
    assert (got[1]["status"], got[1]["mime"]) == ("404", None) and got[2]["extras"] == {"q": "rest of line"}


def test_bad_rows(spark, tmp_path):
    p = write(tmp_path / "a.cdxj", "com,a)/ 2024 {bad", "single")
    with pytest.raises(Exception, match="can't read row"):
        read_text(spark, [p]).collect()
    got = read_text(spark, [p], strict=False).orderBy("line_number").collect()
    assert [r["corrupt"] for r in got] == ["com,a)/ 2024 {bad", "single"]


def test_gzip_members_line_numbers_and_order(spark, tmp_path):
    (tmp_path / "b.cdxj.gz").write_bytes(gzip.compress((line("com,a)/1") + "\n").encode()) + gzip.compress((line("com,a)/2") + "\n").encode()))
    a = write(tmp_path / "a.cdxj", *(line(f"com,b)/{i:05d}") for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")  # several splits of one file
    try:
        df = Index.open(spark, str(tmp_path)).rows().orderBy("file_ord", "line_number")
        got = [(r["file_ord"], r["line_number"], r["urlkey"]) for r in df.collect()]
        assert df.rdd.getNumPartitions() >= 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(0, i + 1, f"com,b)/{i:05d}") for i in range(3000)] + [(1, 1, "com,a)/1"), (1, 2, "com,a)/2")]
    assert a


def test_expansion(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    write(tmp_path / "sub" / "cdx-00001.gz", line("com,a)/"), compress=True)
    write(tmp_path / "x.CDXJ", line("com,a)/"))
    write(tmp_path / "notes.txt", "no")
    kind, paths = expand(spark, str(tmp_path), str(tmp_path / "*.CDXJ"))
    assert kind == "text" and [p.rpartition("/")[2] for p in paths] == ["cdx-00001.gz", "x.CDXJ"]
    with pytest.raises(ValueError, match="not an index file"):
        expand(spark, str(tmp_path / "notes.txt"))
    with pytest.raises(FileNotFoundError):
        expand(spark, str(tmp_path / "*.none"))
    packed.write_packed(read_text(spark, [str(tmp_path / "x.CDXJ")]), str(tmp_path / "p.parquet"))
    with pytest.raises(ValueError, match="one index"):
        expand(spark, str(tmp_path))
    kind, paths = expand(spark, str(tmp_path / "p.parquet"))
    assert kind == "packed" and len(paths) == 1
    own = Index.open(spark, str(tmp_path / "x.CDXJ"), parser=lambda lines: lines.select(F.lit("k").alias("urlkey"), "line_number"))
    assert own.rows().columns == ["urlkey", "line_number"]


@pytest.fixture
def zipped(tmp_path):
    """A shard of three members and its block index."""
    rows = [line(f"com,{h})/{i}") for h in ("aaa", "example", "zzz") for i in range(3)]
    data, index, at = b"", [], 0
    for part in range(3):
        member = gzip.compress("".join(f"{r}\n" for r in rows[3 * part : 3 * part + 3]).encode())
        index.append(f"{rows[3 * part].split(' {')[0]}\tcdx-00000.gz\t{at}\t{len(member)}\t{part + 1}")
        data, at = data + member, at + len(member)
    (tmp_path / "cdx-00000.gz").write_bytes(data)
    (tmp_path / "cluster.idx").write_text("\n".join(index) + "\nbad line\n")
    return tmp_path, data, index


def test_block_pruning_gives_the_same_rows(spark, zipped):
    folder, data, index = zipped
    plain = Index.open(spark, str(folder)).captures("*.example.com").count()
    pruned = Index.open(spark, str(folder), trust_keys=True)
    got = pruned.captures("*.example.com").collect()
    assert len(got) == plain == 3 and {r["line_number"] for r in got} == {3001, 3002, 3003}
    assert len(zipnum.find(spark, pruned.paths)[0].candidates(UrlPattern.of("*.example.com"))) == 2
    # a broken member that no query needs is not read
    last = int(index[2].split("\t")[2])
    (folder / "cdx-00000.gz").write_bytes(data[:last] + b"x" * (len(data) - last))
    assert pruned.captures("*.example.com").count() == 3
    # blocks that leave bytes out are not trusted
    (folder / "cdx-00000.gz").write_bytes(data)
    (folder / "cluster.idx").write_text("\n".join(index[:2]) + "\n")
    assert Index.open(spark, str(folder), trust_keys=True).captures("*.zzz.com").count() == 3


def test_packed_store_equals_text(spark, tmp_path):
    a = write(tmp_path / "a.cdxj", *(line(f"com,example{h})/{i}", f"2024010{1 + i}000000", status="200" if i % 2 else "404") for h in ("", ",www2", ",x") for i in range(5)))
    df = read_text(spark, [a])
    summary = packed.write_packed(df, str(tmp_path / "p.parquet"), files=3)
    assert summary["record_count"] == 15 and summary["length_sum"] == 150 and summary["first_key"] == "com,example)/0"
    with pytest.raises(FileExistsError):
        packed.write_packed(df, str(tmp_path / "p.parquet"))
    text, store = Index.open(spark, a), Index.open(spark, str(tmp_path / "p.parquet"), trust_keys=True)
    cols = ["urlkey", "timestamp", "url", "status", "line_number"]
    for url, options in (
        (None, {}), ("*.example.com", {}), ("example.com/1", {}), ("example.com/*", {}), ("x.example.com", {"match": "host"}), ("*.example.com", {"from_": "20240102", "to": "20240103"}),
        (None, {"filters": ["=status:404"]}), (None, {"sort": "timestamp", "limit": 4}), (None, {"closest": "20240103", "limit": 3}), (None, {"filters": [named("html")], "limit": 5}),
    ):
        rows = lambda ix: sorted(tuple(r[c] for c in cols) for r in ix.captures(url, **options).collect())  # noqa: E731, B023
        assert rows(text) == rows(store), (url, options)
    with pytest.raises(UnsupportedCollapse):
        text.captures(collapse="urlkey")
    page = store.captures(page_size=4)
    assert len(page) == 4 and len(store.captures(page_size=20, cursor=page.next_cursor)) == 11


def test_pages_over_stores_concatenate_to_the_query(spark, tmp_path):
    """Three stores whose rows have equal places in their files; one of them is empty after the filter."""
    want = []
    for n in range(3):
        own = [line(f"com,h{(i * 7) % 5})/{n}-{i}", f"202401{1 + i:02d}000000", status="404" if n == 1 else "200") for i in range(5)]
        a = write(tmp_path / f"cdx-0000{n}.gz", *own, compress=True)
        packed.write_packed(read_text(spark, [a]), str(tmp_path / "store" / f"cdx-0000{n}.parquet"), files=2)
        want += [f"com,h{(i * 7) % 5})/{n}-{i}" for i in range(5)]
    index, keys = Index.open(spark, str(tmp_path / "store")), lambda rows: [r["urlkey"] for r in rows]
    assert keys(index.captures(limit=15).collect()) == want and keys(index.captures(limit=7, sort=None).collect()) == want[:7]

    def walk(**options):
        out, cursor = [], None
        while True:
            page = index.captures(cursor=cursor, **options)
            out.append(keys(page))
            cursor = page.next_cursor
            if cursor is None:
                return out

    assert walk(page_size=4) == [want[:4], want[4:8], want[8:12], want[12:]]
    assert sum(walk(page_size=3, filters=["=status:200"]), []) == want[:5] + want[10:]
    collapsed = sum(walk(page_size=6, collapse="urlkey"), [])
    assert collapsed == sorted(set(want))
    # a page from the last store on asks for no other
    asked = []
    last = index.captures(page_size=11).next_cursor
    real, index.stores = index.stores, lambda p, a, b: (asked.append((a, b)) if a else None, real(p, a, b))[1]
    assert keys(index.captures(page_size=9, cursor=last)) == want[11:] and {a for a, _ in asked} == {2}


def test_lines_end_at_line_feeds_alone(spark, tmp_path):
    """JSON may hold other separators; a block index gives the same rows as the whole file."""
    rows = [line("com,a)/\u2028x".replace("\u2028", ""), extra="p\u2028q\x85r") for _ in range(2)]
    rows = [r.encode().decode("unicode_escape") for r in rows]
    member = gzip.compress("".join(f"{r}\n" for r in rows).encode())
    (tmp_path / "cdx-00000.gz").write_bytes(member)
    (tmp_path / "cluster.idx").write_text(f"com,a)/ 2024\tcdx-00000.gz\t0\t{len(member)}\t1\n")
    for trust in (True, False):
        got = Index.open(spark, str(tmp_path), trust_keys=trust).captures("*.a.com").collect()
        assert [r["extras"] for r in got] == [{"extra": "p\u2028q\x85r"}] * 2, trust


def test_a_line_is_split_once(spark, tmp_path):
    a = write(tmp_path / "a.cdxj", line("com,a)/"))
    text = read_text(spark, [a])._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("from_json(") == 1 and text.count("split(_line") <= 2, text


def test_manifest_prunes_files(spark, tmp_path):
    a = write(tmp_path / "a.cdxj", *(line(f"com,{c * 3})/") for c in "abcdefghijkl"))
    out = str(tmp_path / "p.parquet")
    packed.write_packed(read_text(spark, [a]), out, files=4)
    kept, every = packed.prune(spark, out, UrlPattern.of("*.aaa.com")), [f for f in os.listdir(out) if f.endswith(".parquet")]
    assert len(kept) == 1 < len(every)
    # a file that changed since is read again, whatever the manifest said of it
    entries = json.loads(Files(spark).read(f"{out}/{packed.MANIFEST}"))
    entries["files"][-1]["bytes"] += 1
    Files(spark).write(f"{out}/{packed.MANIFEST}", json.dumps(entries))
    assert len(packed.prune(spark, out, UrlPattern.of("*.aaa.com"))) == 2
    Files(spark).write(f"{out}/{packed.MANIFEST}", "{broken")
    assert len(packed.prune(spark, out, UrlPattern.of("*.aaa.com"))) == len(every)


def test_validation_follows_filters(spark, tmp_path):
    a = write(tmp_path / "a.cdxj", line("com,a)/1"), line("com,a)/2", url="ftp://a.com/2", status="404"), line("com,a)/3", mime=None, digest="short", length="-1", timestamp="20249901000000", status="404"))
    df = read_text(spark, [a])
    got = {(r["line_number"], r["field"], r["reason"]) for r in packed.violations(df).collect()}
    assert got == {(2, "url", "not http or https"), (3, "mime", "missing"), (3, "digest", "not a canonical base-32 SHA-1"), (3, "length", "not a non-negative integer"), (3, "timestamp", "not a 14-digit time")}
    with pytest.raises(EncodeError):
        packed.checked(df)
    assert packed.checked(Plan(where="=status:200").select(df)).count() == 1


def test_plan_preview_and_sort_checks(spark, tmp_path):
    a = write(tmp_path / "a.cdxj", line("com,b)/", "2024"), line("com,a)/", "2025"), line("com,a)/", "2026", status="404"), line("org,c)/x", "2024"))
    df = read_text(spark, [a])
    assert [(r["line_number"], r["previous_urlkey"]) for r in derive.sorted_violations(df).collect()] == [(2, "com,b)/")]
    plan = Plan(named="html,status_200", only_urls=allowlist.parse_lines(["*.com"]), collapse="urlkey")
    assert sorted(r["urlkey"] for r in plan.select(df).collect()) == ["com,a)/", "com,b)/"]
    p = derive.preview(df, plan).first()
    assert (p["total_count"], p["selected_count"], p["filtered_count"]) == (4, 2, 2) and p["raw_bytes"] > 0
    assert derive.fingerprint(df).first() == derive.fingerprint(df.repartition(3)).first()
    assert plan.signature() == Plan(named=["html", "status_200"], only_urls=allowlist.parse_lines(["*.com"]), collapse="urlkey").signature()


def test_batch_resumes_and_deletes(spark, tmp_path):
    a = write(tmp_path / "cdx-00000.gz", line("com,a)/", "20240101000000"), line("com,b)/", "20240101000000"), compress=True)
    b = write(tmp_path / "cdx-00001.gz", line("com,b)/", "20240102000000"), line("com,c)/", "20240101000000", mime=None), compress=True)
    out, plan = str(tmp_path / "out"), Plan(collapse="urlkey")
    with pytest.raises(EncodeError):
        derive.batch(spark, [a, b], out, plan)
    states = [e["state"] for e in json.loads((tmp_path / "out" / "_derive_ledger.json").read_text())["entries"]]
    assert states == ["complete", "failed"]
    with pytest.raises(ValueError, match="exists"):
        derive.batch(spark, [a, b], out, plan)
    with pytest.raises(ValueError, match="another plan"):
        derive.batch(spark, [a, b], out, Plan(), resume=True)
    assert any(n.startswith("_selection-") for n in os.listdir(out))  # the winners, picked once
    done = derive.batch(spark, [a, b], out, plan, resume=True, check=False, delete_sources=True)
    assert not any(n.startswith("_selection-") for n in os.listdir(out))
    assert [(e.state, e.record_count) for e in done] == [("deleted", 1), ("deleted", 2)] and not os.path.exists(a)
    assert sorted(r["urlkey"] for r in spark.read.parquet(*[e.output for e in done]).collect()) == ["com,a)/", "com,b)/", "com,c)/"]
    again = derive.batch(spark, [a, b], out, plan, resume=True, check=False, delete_sources=True)
    assert [e.state for e in again] == ["deleted", "deleted"]
    with pytest.raises(ValueError, match="collide"):
        derive.batch(spark, [str(tmp_path / "x" / "cdx-1.gz"), str(tmp_path / "y" / "cdx-1.gz")], out, plan)


def test_sorted_input_can_be_asked_for(spark, tmp_path):
    a = write(tmp_path / "cdx-00000.gz", line("com,b)/"), line("com,a)/"), compress=True)
    with pytest.raises(CaptureError, match=":2: "):
        derive.batch(spark, [a], str(tmp_path / "out"), Plan(), sorted_input=True, check=False)
    done = derive.batch(spark, [a], str(tmp_path / "out"), Plan(), fmt="cdxj", resume=False, ledger=str(tmp_path / "other.json"))
    assert done[0].record_count == 2 and derive.batch(spark, [a], str(tmp_path), Plan(), fmt="cdxj", ledger=str(tmp_path / "third.json"))[0].output.endswith("cdx-00000.filtered.gz")


def test_text_output_keeps_raw_lines(spark, tmp_path):
    raw = line("com,a)/1", odd="kept")
    a = write(tmp_path / "a.cdxj", raw, line("com,b)/"))
    assert derive.write_cdxj(read_text(spark, [a]).where("urlkey like 'com,a%'"), str(tmp_path / "o")) == 1
    assert spark.read.text(str(tmp_path / "o")).first()[0] == raw
    assert derive.output_name("/x/cdx-00000.gz") == "cdx-00000.parquet" and derive.output_name("a.cdxj.gz", "cdxj", True) == "a.filtered.cdxj.gz"


def test_catalogue(tmp_path):
    paths = "\n".join(["cc-index/collections/CC-MAIN-2024-05/indexes/cdx-00001.gz", "cc-index/collections/CC-MAIN-2024-05/indexes/cdx-00000.gz", "cc-index/collections/CC-MAIN-2024-05/indexes/cluster.idx", "cc-index/collections/CC-MAIN-2023-01/indexes/cdx-00000.gz", "other"])
    answers = {"list": json.dumps([{"id": "CC-MAIN-2023-01", "name": "old"}, {"id": "CC-MAIN-2024-05", "name": "new", "from": "a", "to": "b"}]).encode(), "paths": gzip.compress(paths.encode())}
    fetched = []

    def save(url, target):
        fetched.append(url)
        if "fail" in target:
            raise OSError("no")
        with open(target, "w") as f:
            f.write(url)

    c = Catalog(lambda url: answers["paths" if url.endswith("paths.gz") else "list"], save)
    assert [x.id for x in c.crawls()] == ["CC-MAIN-2024-05", "CC-MAIN-2023-01"]
    assert [p.rpartition("/")[2] for p in c.index_paths("CC-MAIN-2024-05", 1)] == ["cdx-00000.gz", "cluster.idx"]
    assert c.index_paths("CC-MAIN-2024-05", 0) == [] and len(c.index_paths("CC-MAIN-2024-05", zipnum=False)) == 2 and c.latest_crawl().id == "CC-MAIN-2024-05"
    first = c.fetch_index("CC-MAIN-2024-05", str(tmp_path))
    second = c.fetch_index("CC-MAIN-2024-05", str(tmp_path))
    assert [d.skipped for d in first + second] == [False] * 3 + [True] * 3 and len(fetched) == 3
    with pytest.raises(ValueError):
        c.index_paths("../x")
    with pytest.raises(OSError):
        c.fetch_index("CC-MAIN-2024-05", str(tmp_path / "fail"))
    assert os.listdir(tmp_path / "fail") == []
    out = io.StringIO()
    assert cli.run(cli.parser().parse_args(["data", "list", "--crawl", "CC-MAIN-2024-05", "--limit", "1"]), catalog=c, out=out) == 0 and "cdx-00000.gz" in out.getvalue()


def test_command_line(spark, tmp_path, capsys):
    a = write(tmp_path / "a.cdxj", line("com,a)/1", "20240101000000"), line("com,a)/2", "20240102000000", status="404"))

    def run(*argv):
        out = io.StringIO()
        assert cli.run(cli.parser().parse_args(list(argv)), spark, out=out) == 0
        return out.getvalue()

    assert run("captures", "--index", a, "a.com/*") == "200 20240101000000 https://a.com/1\n404 20240102000000 https://a.com/2\n"
    assert run("count", "--index", a, "--filter", "status_200", "--limit", "0") == "1\n"
    assert run("captures", "--index", a, "--format", "csv", "--fields", "status,url", "--sort", "reverse_timestamp") == "status,url\n404,https://a.com/2\n200,https://a.com/1\n"
    assert json.loads(run("captures", "--index", a, "--format", "jsonl", "--limit", "1"))["urlkey"] == "com,a)/1"
    assert run("captures", "--index", a, "--format", "cdxj", "--limit", "1").startswith("com,a)/1 20240101000000 {")
    assert "selected_count 1" in run("derive", "--output", str(tmp_path / "o"), "--named", "status_200", "--dry-run", a)
    assert run("derive", "--output", str(tmp_path / "o"), "--named", "status_200", a).startswith("complete 1 ")
    assert cli.main(["captures", "--index", "/nowhere/x.cdxj", "--limit", "-1"]) == 1
    assert "capweave:" in capsys.readouterr().err


def test_stream_ingest(spark, tmp_path):
    from capweave.streaming.ingest import ingest

    (tmp_path / "in").mkdir()
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), Plan(named="status_200"))
    write(tmp_path / "in" / "a.cdxj", line("com,b)/"), line("com,a)/"), line("com,c)/", status="404"))
    ingest(*args).awaitTermination(120)
    write(tmp_path / "in" / "b.cdxj.gz", line("com,d)/"), compress=True)
    ingest(*args).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["batch"], r["urlkey"]) for r in got.collect()) == [(0, "com,a)/"), (0, "com,b)/"), (1, "com,d)/")]


def test_stream_windows(spark, tmp_path):
    from capweave.streaming.ingest import windowed_counts

    df = spark.createDataFrame([("20240101000500", "200"), ("20240101005900", "200"), ("20240101010000", "404")], "timestamp string, status string")
    assert sorted(r["captures"] for r in windowed_counts(df).collect()) == [1, 2]
