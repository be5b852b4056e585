"""Commands on a store: ``python -m tidestore.cli --base-dir DIR compact|sweep|stats|import ...``."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidestore.functions import paths
from tidestore.model import StoreConfig
from tidestore.operators import rrd
from tidestore.operators.catalog import metric_key
from tidestore.sources import rrd_files
from tidestore.sources.store import SampleStore

NODES = "node int, foreign_source string, foreign_id string"


def read_nodes(spark: SparkSession, url: str, **options: str) -> DataFrame:
    """The node table over JDBC."""
    query = "select nodeid as node, foreignsource as foreign_source, foreignid as foreign_id from node"
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def import_dumps(store: SampleStore, root: str, by_metric: bool = False, nodes: DataFrame | None = None, program: str | None = None) -> dict[str, int]:
    """Import every XML dump under ``root``, or with a ``program`` what that dumps of every binary archive.

    Returns files read, files skipped and samples written.

    ``response`` is always taken by group, ``snmp`` by group or by metric. ``nodes`` (node, foreign_source,
    foreign_id) turns node numbers in paths into foreign sources; dumps of unknown nodes are left out.
    """
    spark = store.spark
    dumps = rrd_files.dump_binaries(spark, root, program) if program else rrd_files.read_dumps(spark, root)
    directory = F.regexp_replace("file", "/[^/]*$", "")
    stem = paths.remove_extension(F.regexp_extract("file", "([^/]*)$", 1))
    named = dumps.select("file", "dump", directory.alias("directory"), stem.alias("stem"))
    by_group = rrd_files.groups_by_directory(spark, root)
    found = named.join(by_group, (named["directory"] == by_group["directory"]) & (named["stem"] == by_group["grp"])).select("file", "dump", named["directory"], "grp")
    if by_metric:
        metas = rrd_files.groups_by_metric(spark, root)
        other = named.join(metas, (named["directory"] == metas["directory"]) & (named["stem"] == metas["metric"])).select("file", "dump", named["directory"], "grp")
        found = found.where("directory like '%/response/%'").unionByName(other.where("directory like '%/snmp/%'"))
    external = rrd_files.external_tags(spark, root)
    none = F.array().cast(external.schema["external"].dataType)  # not null: the tags are a key of what follows
    tagged = found.join(external, "directory", "left").withColumn("external", F.coalesce("external", none))
    relative = F.regexp_replace("directory", "^.*/(?=(snmp|response)/)", "")
    pathed = tagged.withColumn("e", paths.path_elements(relative))
    known = nodes if nodes is not None else spark.createDataFrame([], NODES)
    joined = pathed.withColumn("_node", paths.node_of("e") if nodes is not None else F.lit(None).cast("int")).join(known, F.col("_node") == F.col("node"), "left")
    resource = paths.path_text(paths.import_path("e", nodes is not None, F.col("foreign_source"), F.col("foreign_id")))
    ready = joined.withColumn("resource", resource).where("resource is not null and dump is not null").select("file", "dump", "resource", "grp", "external")
    keys = ["file", "resource", "grp", "external"]
    rows = rrd.import_samples(rrd.history(ready, keys), "resource", "grp", "external")
    stored = rows.withColumn("metric_key", metric_key()).withColumn("seq", F.lit(1).cast("long"))
    metrics = stored.select("metric_key", "intrinsic", "meta", "external", "seq").dropDuplicates(["metric_key"])
    before = store.counters["samples_written"]
    store.upsert(metrics)
    store.bulk_import(stored)
    skipped = dumps.where("dump is null").count()
    return {"files": dumps.count() - skipped, "skipped": skipped, "samples": store.counters["samples_written"] - before}


def main(argv: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidestore")
    parser.add_argument("--base-dir", required=True)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("compact", "sweep", "stats"):
        commands.add_parser(name)
    imports = commands.add_parser("import")
    imports.add_argument("root")
    imports.add_argument("--yes", action="store_true", help="confirm that the tree is to be imported")
    imports.add_argument("--by-metric", action="store_true")
    imports.add_argument("--tool", choices=("xml", "rrdtool"), default="xml", help="read XML dumps, or have binary archives dumped")
    imports.add_argument("--program", default="rrdtool", help="the program that dumps binary archives, on every executor")
    imports.add_argument("--nodes", help="JDBC address of the node table; turns node numbers into foreign sources")
    args = parser.parse_args(argv)
    if args.command == "import" and not args.yes:
        parser.error("import needs --yes")
    spark = SparkSession.builder.getOrCreate()
    with SampleStore(spark, StoreConfig(base_dir=args.base_dir)) as store:
        if args.command == "compact":
            print(f"partitions compacted: {store.compact()}")
        elif args.command == "sweep":
            print(f"partitions deleted: {store.sweep()}")
        elif args.command == "stats":
            for r in store.stats().collect():
                print(f"{r['measure']}: {r['value']}")
        else:
            nodes = read_nodes(spark, args.nodes) if args.nodes else None
            print(import_dumps(store, args.root, args.by_metric, nodes, args.program if args.tool == "rrdtool" else None))
    return 0


if __name__ == "__main__":
    sys.exit(main())
