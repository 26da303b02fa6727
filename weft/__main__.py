"""python -m weft: merge lanes, run a preflight, show shares.

Exit codes: 0 done, 1 a gate or a failed check, 2 wrong arguments."""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="weft")
    commands = top.add_subparsers(dest="command", required=True)
    for name, text in (("merge", "unite training lanes of a catalog in seeded order"), ("preflight", "validate a catalog's mixture and leave artifacts"), ("shares", "rows of each lane of a catalog")):
        c = commands.add_parser(name, help=text)
        c.add_argument("catalog")
        c.add_argument("--lanes", nargs="*")
        c.add_argument("--max-images", type=int)
        c.add_argument("--max-length", type=int)
        c.add_argument("--max-rows-per-lane", type=int)
        c.add_argument("--seed", type=int, default=42)
        c.add_argument("--set", action="append", default=[], metavar="KEY=VALUE")
        c.add_argument("--dry-run", action="store_true")
        if name != "shares":
            c.add_argument("output")
    return top


def main(args: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from weft.operators.mixture import MixtureError
    from weft.plans.governance import GateError, resolve
    from weft.sources.catalog import Catalog, CatalogError

    try:
        options = parser().parse_args(args)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        stated = {k: v for k, v in vars(options).items() if k not in ("set", "dry_run", "output") and v is not None}
        config, digest = resolve(stated, options.set)
        if options.dry_run:
            print(json.dumps({"config": config, "config_hash": digest}, sort_keys=True))
            return 0
        catalog = Catalog(SparkSession.builder.getOrCreate(), config["catalog"])
        if options.command == "shares":
            print(json.dumps({f"{e['config_name']}/{e['split']}": e["rows"] for e in catalog.manifest()["subsets"]}, sort_keys=True))
            return 0
        mixture = catalog.mixture(config.get("lanes"), max_images=config.get("max_images"), max_length=config.get("max_length"), most_rows=config.get("max_rows_per_lane"), seed=config["seed"])
        if options.command == "merge":
            mixture.write.parquet(options.output)
            return 0
        from weft.plans.preflight import run

        return 0 if run(mixture, config, options.output)["passed"] else 1
    except (GateError, MixtureError, CatalogError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
