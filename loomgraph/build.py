"""Builds a graph from a runner's options: rules over CSV files to N-Triples, with a report."""

from __future__ import annotations

import argparse
import posixpath
from dataclasses import dataclass

from pyspark.sql import SparkSession

from .plans.compiler import Build, build_csv, store
from .sources.config import BuildConfig, read_config
from .sources.ntriples import write_ntriples
from .sources.rules import Rule, read_rules
from .sources.shared import read_text


@dataclass(frozen=True)
class Report:
    """What a build read, what was missing, and what it wrote; ``path`` is the first of ``paths``."""

    rules: int
    missing: tuple[str, ...]
    triples: int
    path: str
    paths: tuple[str, ...] = ()


def load(spark: SparkSession, config_path: str, base: str | None = None) -> tuple[BuildConfig, dict[str, list[Rule]], str]:
    """Options, and the rules of each data set. Paths within are relative to ``base``, by default the folder above the options' own."""
    base = base or posixpath.dirname(posixpath.dirname(config_path)) or "."
    config = read_config(read_text(spark, config_path))
    at = lambda m: posixpath.normpath(posixpath.join(base, m)) if "://" not in base else f"{base}/{m.removeprefix('./')}"
    return config, {name: read_rules(read_text(spark, at(mapping))) for name, mapping in config.datasets}, base


def build(spark: SparkSession, config_path: str, base: str | None = None, output: str | None = None, strict: bool = False, parquet: str | None = None) -> Report:
    """Run a build: a file of lines for each data set, named after it, or one for all if the options say so; each triple once
    in a file if they say that.

    ``output`` replaces the options' folder; ``parquet`` also stores the graph by predicate there.
    """
    config, rules, base = load(spark, config_path, base)
    together = {config.name: [r for own in rules.values() for r in own]}
    folder = (output or posixpath.join(base, config.output_folder)).rstrip("/")
    missing, paths, triples = [], [], 0
    for name, own in (together if config.all_in_one_file or len(rules) == 1 else rules).items():
        built: Build = build_csv(spark, own, base, strict)
        paths.append(f"{folder}/{name}.nt")
        write_ntriples(built.graph() if config.remove_duplicate else built.triples, paths[-1], one_file=config.all_in_one_file)
        missing += [m for m in built.missing if m not in missing]
        triples += spark.read.text(paths[-1]).count()
    if parquet:
        whole = build_csv(spark, together[config.name], base, strict)
        store(whole.graph() if config.remove_duplicate else whole.triples, parquet)
    return Report(sum(map(len, rules.values())), tuple(missing), triples, paths[0], tuple(paths))


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("config", help="options as INI")
    parser.add_argument("--base", help="folder that paths in the options and rules are relative to")
    parser.add_argument("--output", help="folder for the result")
    parser.add_argument("--strict", action="store_true", help="fail if a source is missing")
    args = parser.parse_args()
    report = build(SparkSession.builder.appName("loomgraph").getOrCreate(), args.config, args.base, args.output, args.strict)
    print(f"{report.triples} triples of {report.rules} rules in {", ".join(report.paths)}; missing: {', '.join(report.missing) or 'none'}")


if __name__ == "__main__":
    main()
