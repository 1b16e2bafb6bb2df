"""Jobs from the command line: python -m tessera JOB ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tessera import jobs


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera", description="Filing retrieval and corpus analytics on Spark")
    job = top.add_subparsers(dest="job", required=True)

    def add(name: str, *paths: str, **options) -> argparse.ArgumentParser:
        p = job.add_parser(name)
        for path in paths:
            p.add_argument(path)
        p.add_argument("--overwrite", action="store_true")
        for key, default in options.items():
            flag = "--" + key.replace("_", "-")
            if isinstance(default, bool):
                p.add_argument(flag, action="store_true")
            else:
                p.add_argument(flag, type=type(default) if default is not None else str, default=default)
        return p

    add("blocks", "pages", "out", whole_body=False)
    add("chunks", "blocks", "out", config=None)
    add("embed", "chunks", "out", width=64)
    add("search", "documents", "queries", "out", k=30)
    add("dense", "vectors", "queries", "out", k=30)
    add("fuse", "out", rrf_k=60, k=30, id_col="doc_id").add_argument("--list", action="append", required=True, dest="lists")
    add("evaluate", "results", "gold", "documents", "out", id_col="doc_id")
    add("report", "blocks", "out")
    add("promote", "folder", "release_id", preflight_only=False).add_argument("--table", action="append", required=True, dest="tables", metavar="NAME=PATH")
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName(f"tessera-{a.job}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.job == "blocks":
        jobs.blocks(spark, a.pages, a.out, a.whole_body, a.overwrite)
    elif a.job == "chunks":
        jobs.chunks(spark, a.blocks, a.out, jobs.read_config(a.config), a.overwrite)
    elif a.job == "embed":
        jobs.embeddings(spark, a.chunks, a.out, a.width, a.overwrite)
    elif a.job == "search":
        jobs.search(spark, a.documents, a.queries, a.out, a.k, a.overwrite)
    elif a.job == "dense":
        jobs.dense_search(spark, a.vectors, a.queries, a.out, a.k, a.overwrite)
    elif a.job == "fuse":
        jobs.fuse(spark, a.lists, a.out, a.id_col, a.rrf_k, a.k, a.overwrite)
    elif a.job == "evaluate":
        jobs.evaluate(spark, a.results, a.gold, a.documents, a.out, a.id_col, a.overwrite)
    elif a.job == "report":
        jobs.report(spark, a.blocks, a.out, a.overwrite)
    else:
        print(jobs.promote(spark, a.folder, dict(t.split("=", 1) for t in a.tables), a.release_id, a.preflight_only))


if __name__ == "__main__":
    main()
