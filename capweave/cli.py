"""Command line: captures, count, derive, data list, data download, version."""

from __future__ import annotations

import argparse
import sys

from capweave import __version__
from capweave.schema import CSV_FIELDS, CaptureError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="capweave", description="Query and derive web-archive capture indexes on Spark.")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("captures", "count"):
        q = sub.add_parser(name)
        q.add_argument("--index", action="append", required=True, help="file, folder or glob; may repeat")
        q.add_argument("--match", choices=("exact", "prefix", "host", "domain"))
        q.add_argument("--from", dest="from_")
        q.add_argument("--to")
        q.add_argument("--filter", action="append", default=[])
        q.add_argument("--limit")
        q.add_argument("--sort", choices=("timestamp", "reverse_timestamp"))
        q.add_argument("--closest")
        q.add_argument("--collapse")
        q.add_argument("--collapse-order")
        q.add_argument("--fields", action="append")
        q.add_argument("--format", choices=("text", "jsonl", "csv", "cdxj"), default="text")
        q.add_argument("--trust-keys", action="store_true", help="use stored keys to skip files and blocks")
        q.add_argument("url", nargs="?")
    d = sub.add_parser("derive")
    d.add_argument("--output", required=True)
    d.add_argument("--format", choices=("packed", "cdxj"), default="packed")
    d.add_argument("--named", action="append", default=[])
    d.add_argument("--where", action="append", default=[])
    d.add_argument("--only-urls", action="append", default=[])
    d.add_argument("--collapse")
    d.add_argument("--collapse-order")
    d.add_argument("--ledger")
    d.add_argument("--resume", action="store_true")
    d.add_argument("--force", action="store_true")
    d.add_argument("--delete-sources", action="store_true")
    d.add_argument("--dry-run", action="store_true")
    d.add_argument("--no-check", action="store_true", help="packed only: accept rows that the store would reject")
    d.add_argument("sources", nargs="+")
    data = sub.add_parser("data").add_subparsers(dest="data_command", required=True)
    ls = data.add_parser("list")
    ls.add_argument("--crawl")
    ls.add_argument("--limit", type=int)
    get = data.add_parser("download")
    get.add_argument("--crawl", required=True)
    get.add_argument("--folder", required=True)
    get.add_argument("--limit", type=int)
    get.add_argument("--force", action="store_true")
    return p


def run(args: argparse.Namespace, spark=None, catalog=None, out=None) -> int:
    out = out or sys.stdout
    if args.command == "data":
        from capweave.sources.catalog import Catalog

        catalog = catalog or Catalog()
        if args.data_command == "download":
            for d in catalog.fetch_index(args.crawl, args.folder, args.limit, args.force):
                print("skipped" if d.skipped else "downloaded", d.path, file=out)
        elif args.crawl:
            print(*catalog.index_paths(args.crawl, args.limit), sep="\n", file=out)
        else:
            for c in catalog.crawls()[: args.limit]:
                print(c.id, c.name, file=out)
        return 0
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "derive":
        return _derive(args, spark, out)
    from capweave.operators.filters import split_cli_filters
    from capweave.plans import derive
    from capweave.sources.index import Index

    index = Index.open(spark, *args.index, trust_keys=args.trust_keys)
    filters = [f for text in args.filter for f in split_cli_filters(text)]
    options = {"match": args.match, "from_": args.from_, "to": args.to, "filters": filters, "collapse": args.collapse, "collapse_order": args.collapse_order}
    if args.command == "count":
        print(index.count(args.url, **options).first()["captures"], file=out)
        return 0
    fields = args.fields or (list(CSV_FIELDS) if args.format == "csv" else None)
    ordered = {"limit": args.limit, "sort": args.sort, "closest": args.closest}
    rows = index.captures(args.url, fields=fields if args.format in ("csv", "jsonl") else None, **options, **ordered)
    if args.format == "csv":
        import csv

        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(rows.columns)
        for r in rows.toLocalIterator():
            writer.writerow(["" if x is None else x for x in r])
        return 0
    hidden = [c for c in ("raw", "source_path", "line_number", "file_ord") if c in rows.columns]
    lines = {"text": lambda: derive.text_lines(rows), "jsonl": lambda: derive.jsonl(rows.drop(*hidden)), "cdxj": lambda: rows.select(derive.cdxj_line(rows).alias("value"))}[args.format]()
    for r in lines.toLocalIterator():
        print(r["value"], file=out)
    return 0


def _derive(args: argparse.Namespace, spark, out) -> int:
    from capweave.operators.allowlist import read_rules
    from capweave.plans import derive
    from capweave.sources.files import expand
    from capweave.sources.text import read_text

    if args.format == "cdxj" and args.no_check:
        raise ValueError("--no-check is for packed output")
    kind, sources = expand(spark, *args.sources)
    if kind != "text":
        raise ValueError("derive reads text indexes")
    plan = derive.Plan(args.named, args.where, read_rules(spark, *args.only_urls) if args.only_urls else None, args.collapse, args.collapse_order)
    if args.dry_run:
        r = derive.preview(read_text(spark, sources), plan).first()
        print(*(f"{k} {v}" for k, v in r.asDict().items()), sep="\n", file=out)
        return 0
    for e in derive.batch(spark, sources, args.output, plan, args.format, args.ledger, args.resume, args.force, args.delete_sources, check=not args.no_check):
        print(e.state, e.record_count, e.output, file=out)
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        return run(parser().parse_args(argv))
    except KeyboardInterrupt:
        return 130
    except (CaptureError, ValueError, OSError) as error:
        print(f"capweave: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
