"""``python -m stackroom CATALOG VERB ...``: the catalog from a shell."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame

from stackroom.catalog import Catalog
from stackroom.operators import risk
from stackroom.session import session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stackroom", description=__doc__)
    p.add_argument("catalog", help="folder of the catalog, on storage that all nodes share")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *arguments: tuple) -> None:
        v = verbs.add_parser(name)
        for flags, options in arguments:
            v.add_argument(*([flags] if isinstance(flags, str) else flags), **options)

    number = {"type": int}
    verb("scope-add", ("volume", number), ("path", {}), ("--exclude", {"action": "append", "default": []}))
    verb("scope-list")
    verb("scope-remove", ("root", number))
    verb("scope-preview", ("root", number))
    verb("drive-add", ("fields", {"nargs": "*", "metavar": "name=value"}))
    verb("drive-edit", ("drive", number), ("fields", {"nargs": "+", "metavar": "name=value"}))
    verb("drives")
    verb("volume-add", ("fields", {"nargs": "*", "metavar": "name=value"}))
    verb("volume-assign", ("volume", number), ("drive", number))
    verb("volumes")
    verb("scan", ("root", number))
    verb("hash")
    verb("verify")
    verb("find", ("text", {}), ("--after", number), ("--limit", {"type": int, "default": 50}))
    verb("report", ("kind", {"choices": ["summary", "duplicates", "redundancy", "reclamation", "durability", "integrity"]}), ("--min-copies", {"type": int, "default": 2}))
    verb("status")
    verb("standards-import", ("file", {}))
    verb("standards-list")
    verb("standards-forget", ("name", {}))
    verb("collections-propose")
    verb("collections-queue")
    verb("collections-accept", ("dir", number), ("title", {}))
    verb("collections-reject", ("dir", number))
    verb("collections-split", ("dir", number))
    verb("collections-accept-all", ("score", {"type": float}))
    verb("collections-edit", ("collection", number), ("fields", {"nargs": "+", "metavar": "name=value"}))
    verb("collections-show", ("collection", number))
    verb("collections-coverage")
    verb("collections-list")
    verb("versions-find")
    verb("versions-list", ("--vanished", {"action": "store_true"}))
    verb("score")
    verb("plan-make", ("--min-copies", {"type": int, "default": 2}))
    verb("plan-show", ("plan", number))
    verb("plan-list")
    verb("export-list")
    verb("export", ("folder", {}), ("--kind", {"action": "append", "choices": ["manifests", "collections", "reports", "mappings", "previews"]}))
    verb("audit-list")
    verb("audit-verify")
    return p


def fields(pairs: list[str]) -> dict:
    out = dict(p.split("=", 1) for p in pairs)
    return {k: int(v) if k.endswith(("_bytes", "_id", "_cents")) else v for k, v in out.items()}


def run(c: Catalog, a: argparse.Namespace):
    """What a verb does; a DataFrame is shown, anything else printed."""
    reports = {
        "summary": lambda: c.summary(a.min_copies), "duplicates": c.duplicates, "redundancy": lambda: c.under_protected(a.min_copies),
        "reclamation": c.reclamation, "durability": c.durability, "integrity": c.incidents,
    }
    verbs = {
        "scope-add": lambda: c.add_root(a.volume, a.path, a.exclude), "scope-list": c.roots, "scope-remove": lambda: c.remove_root(a.root), "scope-preview": lambda: c.preview(a.root),
        "drive-add": lambda: c.add_drive(**fields(a.fields)), "drive-edit": lambda: c.edit_drive(a.drive, **fields(a.fields)), "drives": lambda: c.drive_names().join(c.drive_risks().select("id", "afr", "confidence"), "id"),
        "volume-add": lambda: c.add_volume(**fields(a.fields)), "volume-assign": lambda: c.assign(a.volume, a.drive), "volumes": c.volumes,
        "scan": lambda: c.scan(a.root), "hash": c.hash, "verify": c.verify, "find": lambda: c.find(a.text, a.after, a.limit), "report": lambda: reports[a.kind](), "status": c.status,
        "standards-import": lambda: c.import_rates(Path(a.file).read_text()), "collections-propose": c.propose, "collections-queue": c.queue, "collections-accept": lambda: c.accept(a.dir, a.title),
        "collections-reject": lambda: c.decide(a.dir, "rejected"), "collections-coverage": c.coverage, "collections-list": c.collections, "versions-find": c.find_versions, "score": lambda: c.score()[0],
        "plan-make": lambda: c.plan(a.min_copies), "plan-show": lambda: c.table("plan_step").where(f"plan_id = {a.plan}").orderBy("id"), "export": lambda: c.export(a.folder, tuple(a.kind or ("manifests", "collections", "reports"))),
        "collections-split": lambda: c.split(a.dir), "collections-accept-all": lambda: c.accept_all(a.score), "collections-edit": lambda: c.edit_collection(a.collection, **fields(a.fields)),
        "collections-show": lambda: c.members(a.collection).select("id", "name", "size_bytes"), "versions-list": lambda: c.versions(a.vanished), "standards-list": lambda: ", ".join(f"{t.source}-{t.version}" for t in risk.ranked(c.rates)),
        "standards-forget": lambda: c.forget_rates(a.name), "plan-list": lambda: c.recent("plan"), "export-list": lambda: c.recent("export"),
        "audit-list": lambda: c.table("audit").orderBy("id"), "audit-verify": c.audit_problems,
    }
    return verbs[a.verb]()


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = session()
    out = run(Catalog(spark, a.catalog), a)
    if isinstance(out, DataFrame):
        out.show(200, truncate=False)
    elif out is not None:
        print(json.dumps(out))


if __name__ == "__main__":
    main()
