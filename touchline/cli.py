"""Command line: measure, compare, validate, select, status over a Parquet panel."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import N_REPLICATES, load_workspace
from .functions.features import default_registry
from .operators.cleaning import asof_join, clean_bars, dedup_keep_last
from .sources.bars import indexed
from .sources.paged import read_paged
from .sources.readers import read_ohlcv
from .store import Store
from .study import Loader, Study

log = logging.getLogger("touchline")

COMMANDS = {
    "measure": "count, by bin of every node, how often barriers are touched",
    "compare": "how far each bin lies from all bars together",
    "validate": "hold bin scores against scores on simulated prices",
    "select": "list the bins whose p-values are low enough",
    "status": "what is done so far, by family or for one node",
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="touchline", description="Barrier-touch probabilities given market conditions.")
    commands = out.add_subparsers(dest="command", required=True, metavar="COMMAND")
    for name, text in COMMANDS.items():
        p = commands.add_parser(name, help=text)
        if name == "status":
            p.add_argument("node", nargs="?", help="id of the node to show")
        if name == "compare":
            p.add_argument("--thin", action="store_true", help="keep shifts alone")
        if name == "validate":
            p.add_argument("--replicates", type=int, default=N_REPLICATES)
        p.add_argument("--workspace", required=True, help="JSON declaration with meta and families")
        p.add_argument("--bars", help="file of ts, open, high, low, close, volume; without it, the history that measure kept")
        p.add_argument("--kind", choices=("parquet", "csv", "json"), default="parquet")
        p.add_argument("--aux", action="append", default=[], metavar="NAME=KIND:PATH:COLUMNS", help="a further source that nodes name in their data: parquet, csv, json or pages; COLUMNS as source=name,... (repeatable)")
        p.add_argument("--store", required=True, help="folder of the results")
        p.add_argument("--plugin", help="Python file with register(registry)")
    return out


def _source(text: str) -> tuple[str, str, str, dict[str, str]]:
    """(name, kind, path, columns) of NAME=KIND:PATH:COLUMNS; the path may hold colons."""
    name, _, rest = text.partition("=")
    kind, _, rest = rest.partition(":")
    path, _, columns = rest.rpartition(":")
    pairs = dict(c.split("=") if "=" in c else (c, c) for c in columns.split(",") if c)
    if not name or kind not in ("parquet", "csv", "json", "pages") or not path or not pairs:
        raise ValueError(f"a source reads NAME=KIND:PATH:COLUMNS, not {text}")
    return name, kind, path, pairs


def loader(args: argparse.Namespace, store: Store, start: str) -> Loader:
    """Loads a panel for a set of sources; what each source held is kept as a snapshot, named by its content."""
    sources = {name: rest for name, *rest in map(_source, args.aux)}

    def kept(name: str, rows: DataFrame) -> DataFrame:
        path = store.snapshot(rows)
        log.info("source %s is kept as %s", name, path)
        return store.spark.read.parquet(path)

    def load(spark: SparkSession, names: tuple[str, ...]) -> DataFrame:
        panel = indexed(clean_bars(kept("ohlcv", read_ohlcv(spark, args.bars, args.kind)), start), "")
        for name in names[1:]:
            if name not in sources:
                raise ValueError(f"no source {name} is given")
            kind, path, columns = sources[name]
            rows = read_paged(spark, path.split(), "time", columns) if kind == "pages" else read_ohlcv(spark, path, kind, columns=columns)
            series = dedup_keep_last(kept(name, rows)).drop("arrival")
            panel = asof_join(panel, series, list(columns.values()))
        return panel

    return load


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(message)s")
    spark = SparkSession.builder.appName("touchline").getOrCreate()
    workspace, registry = load_workspace(args.workspace), default_registry()
    if args.plugin:
        registry.load_plugin(args.plugin)
    store = Store(spark, args.store)
    if args.bars:
        study = Study.of_sources(workspace, loader(args, store, workspace.config.start_date), store, registry)
    else:
        study = Study.restored(workspace, store, registry)
    if args.command == "status":
        study.status(args.node).show(500, truncate=False)
    elif args.command == "validate":
        study.validate(args.replicates).drop("null_scores").orderBy(F.col("monte_carlo_p_value")).show(50, truncate=False)
    elif args.command == "compare":
        print(f"{study.compare(args.thin).count()} rows")
    else:
        print(f"{getattr(study, args.command)().count()} rows")


if __name__ == "__main__":
    main()
