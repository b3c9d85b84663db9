"""Command line.

    python -m quire scan    --registry corpus.json --files original/
    python -m quire extract --registry corpus.json --files original/ --texts extracted/
    python -m quire build   --registry corpus.json --texts extracted/ --index index/
    python -m quire up      --registry corpus.json --files original/ --texts extracted/ --index index/
    python -m quire search  --index index/ "what causes far-end crosstalk?" -k 5 --kind book
    python -m quire context --index index/ 1048577 --before 1 --after 1
    python -m quire books   --index index/ --registry corpus.json [--source 2024]
    python -m quire status  --index index/ --registry corpus.json --files original/
    python -m quire remove  --index index/ --registry corpus.json KEY [--purge --files original/ --texts extracted/]
    python -m quire migrate --index index/ --to other/
    python -m quire registry --from corpus.json --to registry/

A registry is a folder (a table of any size) or a file that ends in .json.
"""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.config import DEFAULTS
from quire.functions.frames import durable
from quire.operators import catalog as C
from quire.operators.maintenance import purgeable
from quire.operators.retrieval import cite_row, preview
from quire.plans import serve
from quire.plans.build import build
from quire.plans.extract import extract
from quire.plans.register import register
from quire.plans.stages import Stages
from quire.session import session
from quire.sources.pages import ENGINES, delete_files, read_marked_text, remove_marked_text, scan_files, write_marked_text
from quire.sources.registry_file import open_registry, read_settings, save_registry
from quire.sources.store import Store


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quire", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *options: str, index: bool = True) -> argparse.ArgumentParser:
        sub = commands.add_parser(name)
        if index:
            sub.add_argument("--index", required=True)
        for option in options:
            sub.add_argument(option, required=True)
        return sub

    def reading(sub: argparse.ArgumentParser) -> None:
        sub.add_argument("--engine", choices=sorted(ENGINES), default="pymupdf")

    def choosing(sub: argparse.ArgumentParser) -> None:
        sub.add_argument("--only", nargs="*")
        sub.add_argument("--force", action="store_true")

    def loading(sub: argparse.ArgumentParser) -> None:
        sub.add_argument("--text-files", action="store_true", help="texts are single files, named by the registry")
        sub.add_argument("--recreate", action="store_true")
        sub.add_argument("--limit", type=int, help="passages per document")
        sub.add_argument("--no-ingest", action="store_true", help="stop after chunking")
        sub.add_argument("--shards", type=int, default=256, help="partitions of a new index")

    def looking(sub: argparse.ArgumentParser) -> None:
        sub.add_argument("--scan-limit", type=int, help="the first files only")

    p = command("scan", "--registry", "--files", index=False)
    reading(p), looking(p)
    p = command("extract", "--registry", "--files", "--texts", index=False)
    reading(p), choosing(p)
    p = command("build", "--registry", "--texts")
    choosing(p), loading(p)
    p = command("up", "--registry", "--files", "--texts")
    reading(p), looking(p), choosing(p), loading(p)
    p.add_argument("--keep-going", action="store_true", help="index the rest even if a file has no text layer")
    p = command("search")
    p.add_argument("query")
    p.add_argument("-k", type=int, default=DEFAULTS.k)
    p.add_argument("--candidates", type=int, default=DEFAULTS.candidates)
    p.add_argument("--book")
    p.add_argument("--source")
    p.add_argument("--kind")
    p.add_argument("--no-rerank", dest="rerank", action="store_false")
    p.add_argument("--full", action="store_true")
    p = command("context")
    p.add_argument("chunk_id", type=int)
    p.add_argument("--before", type=int, default=1)
    p.add_argument("--after", type=int, default=1)
    command("books", "--registry").add_argument("--source")
    command("status", "--registry", "--files")
    p = command("remove", "--registry")
    p.add_argument("key", nargs="+")
    p.add_argument("--purge", action="store_true", help="delete its file and text as well")
    p.add_argument("--files")
    p.add_argument("--texts")
    command("migrate", "--to")
    command("registry", "--from", "--to", index=False)
    return top


def known(spark: SparkSession, path: str) -> DataFrame:
    return durable(open_registry(spark, path))


def scan(spark: SparkSession, args: argparse.Namespace) -> None:
    """Registers the files that the registry does not know."""
    files = scan_files(spark, args.files)
    if args.scan_limit:
        files = files.orderBy("path").limit(args.scan_limit)
    after, report = register(files, args.files, known(spark, args.registry), args.engine, read_settings(args.registry))
    show(report.orderBy(report.columns[0]))
    save_registry(after, args.registry)


def extraction(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Extracts registered documents whose text is missing or stale; gives the report."""
    texts = read_marked_text(spark, args.texts) if Path(args.texts).exists() else spark.createDataFrame([], "key string, text string")
    fresh, report, after = extract(known(spark, args.registry), texts, args.files, args.engine, args.only, args.force)
    fresh, report = durable(fresh), durable(report)
    if Path(args.texts).exists():
        remove_marked_text(spark, args.texts, fresh)
    write_marked_text(fresh, args.texts, "append")
    show(report.orderBy(report.columns[0]))
    save_registry(after, args.registry)
    return report


def load(spark: SparkSession, args: argparse.Namespace, store: Store) -> None:
    """Brings the stages and the index in step with the registered texts."""
    registry = open_registry(spark, args.registry)
    texts = read_marked_text(spark, args.texts, registry if args.text_files else None)
    found = registry.drop("text").join(texts, "key", "left")
    for r in found.filter("text is null").select("key").orderBy("key").toLocalIterator():
        print(f"{r['key']}: MISSING, no text")
    loaded = build(
        found.filter("text is not null"), store, read_settings(args.registry), keys=args.only, force=args.force,
        recreate=args.recreate, limit=args.limit, load=not args.no_ingest,
    )
    if args.no_ingest:
        print("stopped before the index")
        return
    show(loaded.select("key", "chunks").orderBy("key"))
    print(f"{store.count()} points at {store.path}")


def show(table: DataFrame) -> int:
    """Prints every row, a partition at a time; gives their number."""
    print("  ".join(table.columns))
    n = 0
    for row in table.toLocalIterator():
        print("  ".join("" if x is None else str(x) for x in row))
        n += 1
    return n


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = session()
    if args.command == "registry":
        return save_registry(known(spark, vars(args)["from"]), args.to)
    if args.command == "scan":
        return scan(spark, args)
    if args.command == "extract":
        extraction(spark, args)
        return None
    store = Store(spark, args.index, getattr(args, "shards", 256))
    if args.command == "up":
        scan(spark, args)
        unread = extraction(spark, args).filter("status = 'NO TEXT LAYER'").count()
        if unread and not args.keep_going:
            raise SystemExit(f"{unread} documents have no text layer: make one, or go on without them by --keep-going")
        load(spark, args, store)
    elif args.command == "build":
        load(spark, args, store)
    elif args.command == "search":
        asked = spark.createDataFrame([(0, args.query)], "qid bigint, text string")
        hits = serve.search(
            store, asked, k=args.k, candidates=args.candidates, book=args.book, source=args.source,
            kind=args.kind, rerank_hits=args.rerank,
        )
        score = F.col("rerank_score") if args.rerank else F.col("score")
        # at most k rows
        for r in hits.select("rank", score.alias("s"), cite_row().alias("c"), preview(F.col("text"), args.full).alias("t")).orderBy("rank").collect():
            print(f"\n[{r['rank']}] {r['s']:.4f}  {r['c']}\n    {r['t']}")
    elif args.command == "context":
        anchor = spark.createDataFrame([(args.chunk_id,)], "chunk_id bigint")
        print(serve.read_context(store, anchor, args.before, args.after).first()["rendered"])
    elif args.command == "books":
        listed = serve.list_books(store, open_registry(spark, args.registry), args.source)
        if show(listed.orderBy(*listed.columns[:2])) == 0 and args.source:
            print(C.nothing_under(args.source))
    elif args.command == "status":
        for name, table in serve.status(store, open_registry(spark, args.registry), scan_files(spark, args.files)).items():
            print(name)
            show(table.orderBy(*table.columns[:1]))
    elif args.command == "remove":
        registry, keys = durable(open_registry(spark, args.registry)), spark.createDataFrame([(k,) for k in args.key], "key string")
        unknown = keys.join(registry, "key", "left_anti").collect()
        if unknown:
            raise SystemExit(f"no document {', '.join(r['key'] for r in unknown)} in the registry")
        store.remove(keys)
        Stages(store).remove(keys)
        if args.purge:
            if args.files:
                delete_files(purgeable(registry, keys).select(F.col("pdf").alias("path")), args.files)
            if args.texts:
                remove_marked_text(spark, args.texts, keys)
        save_registry(registry.join(keys, "key", "left_anti"), args.registry)
        print(f"removed {', '.join(args.key)}; {store.count()} points left")
        if not args.purge:
            print("a scan registers the file again unless it is deleted too (--purge)")
    elif args.command == "migrate":
        points, manifest = store.copy_to(Store(spark, args.to))
        print(f"copied {points} points and {manifest} manifest entries")


if __name__ == "__main__":
    main()
