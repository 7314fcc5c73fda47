"""Command line over an artifact store: publish, read, verify, inspect, archive, and whole portfolio runs.

    python -m chronofold.cli STORE publish ID TABLE --key date ticker --date date [--mode partition_upsert --partition year]
    python -m chronofold.cli STORE inspect | verify | archive ID FINGERPRINT | sessions ID LAST TODAY
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from chronofold.operators.relational import ContractError, duplicates
from chronofold.session import local_session
from chronofold.sources.artifacts import MODES, Contract, Store, missing_sessions


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chronofold")
    p.add_argument("store")
    sub = p.add_subparsers(dest="command", required=True)
    publish = sub.add_parser("publish")
    publish.add_argument("artifact")
    publish.add_argument("table")
    publish.add_argument("--key", nargs="+", required=True)
    publish.add_argument("--date")
    publish.add_argument("--mode", choices=MODES, default="full_replace")
    publish.add_argument("--partition")
    publish.add_argument("--drop-absent", action="store_true")
    for name in ("inspect", "verify"):
        sub.add_parser(name).add_argument("artifacts", nargs="*")
    archive = sub.add_parser("archive")
    archive.add_argument("artifact")
    archive.add_argument("fingerprint")
    days = sub.add_parser("sessions")
    days.add_argument("artifact")
    days.add_argument("last")
    days.add_argument("today")
    return p


def main(argv: Sequence[str] | None = None, spark=None) -> int:
    """0 if all went well; what was found is printed as JSON."""
    args = parser().parse_args(argv)
    spark = spark or local_session()
    store = Store(spark, args.store)
    try:
        if args.command == "publish":
            c = Contract(args.artifact, tuple(args.key), tuple(args.key), args.date, mode=args.mode, partition=args.partition)
            m = store.publish(c, spark.read.parquet(args.table), args.drop_absent)
            print(json.dumps({"artifact": args.artifact, "rows": m["rows"], "partitions": len(m["partitions"])}))
            return 0
        if args.command == "archive":
            print(json.dumps({"moved": store.archive(args.artifact, args.fingerprint)}))
            return 0
        if args.command == "sessions":
            print(json.dumps(missing_sessions(store.read(args.artifact, validate="none"), args.last, args.today)))
            return 0
        good = True
        for name in args.artifacts or store.names():
            m = store.manifest(name)
            if m is None:
                raise ContractError(f"no manifest of {name}")
            found = {"artifact": name, "rows": m["rows"], "date_range": m["date_range"], "fingerprint": store.fingerprint(name)}
            if args.command == "verify":
                rows = spark.read.parquet(*m["partitions"].values())
                found |= {"count_holds": rows.count() == m["rows"], "repeated_keys": duplicates(rows, m["key"]).count()}
                good &= found["count_holds"] and not found["repeated_keys"]
            print(json.dumps(found))
        return 0 if good else 1
    except ContractError as e:
        print(json.dumps({"error": str(e)}), file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
