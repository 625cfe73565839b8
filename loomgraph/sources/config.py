"""The runner's options, from an INI file."""

from __future__ import annotations

import configparser
from dataclasses import dataclass


@dataclass(frozen=True)
class BuildConfig:
    """What a build needs. Options that carry no meaning here are kept in ``recorded``."""

    mappings: tuple[str, ...]
    output_folder: str
    name: str
    remove_duplicate: bool = True
    all_in_one_file: bool = False
    recorded: tuple[tuple[str, str], ...] = ()
    #: (name, mapping) of each data set's section; a name that two share, or that is missing, is told apart by its section.
    datasets: tuple[tuple[str, str], ...] = ()


def read_config(text: str) -> BuildConfig:
    ini = configparser.ConfigParser(interpolation=None)
    ini.read_string(text)
    main = ini["datasets"]
    yes = lambda key, default: main.get(key, default).strip().lower() in ("yes", "true", "1", "on")
    parts = [s for s in ini.sections() if s.startswith("dataset") and s != "datasets"]
    if len(parts) != main.getint("number_of_datasets", len(parts)):
        raise ValueError(f"number_of_datasets says {main['number_of_datasets']}, but there are {len(parts)} dataset sections")
    used = {"output_folder", "name", "remove_duplicate", "all_in_one_file", "number_of_datasets"}
    named = [ini[s].get("name", s) for s in parts]
    datasets = tuple((n if named.count(n) == 1 else f"{n}-{s}", ini[s]["mapping"]) for n, s in zip(named, parts, strict=True))
    return BuildConfig(tuple(ini[s]["mapping"] for s in parts), main.get("output_folder", "."), main.get("name", "graph"), yes("remove_duplicate", "yes"), yes("all_in_one_file", "no"), tuple(sorted((k, v) for k, v in main.items() if k not in used)), datasets)
