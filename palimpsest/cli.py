"""Command line: init, commit, branch, checkout, migrate, query and serve."""

from __future__ import annotations

import argparse
import os
import sys

from palimpsest.engine import Engine
from palimpsest.errors import CodecError, InputOutputError, PalimpsestError
from palimpsest.language.syntax import Commit, Literal
from palimpsest.session import session
from palimpsest.sources import schema
from palimpsest.sources.repository import META, Repository

FOLDER = ".palimpsest"
EXAMPLE = """-- Example schema migration. Uncomment and run: migrate
-- CREATE COLLECTION items KEY id STRING;
-- CREATE INDEX ON items (id);
"""


def _folder(path: str) -> str:
    """The repository's folder: the path itself, or the hidden one in it."""
    inside = os.path.join(path, FOLDER)
    for candidate in (path, inside):
        if os.path.exists(os.path.join(candidate, META)):
            return candidate
    raise InputOutputError(f"not a repository: {path}")


def _init(args: argparse.Namespace) -> None:
    target = args.path if os.path.basename(args.path) == FOLDER else os.path.join(args.path, FOLDER)
    if os.path.exists(target):
        raise InputOutputError(f"repository already exists: {target}")
    repo = Repository.init(session(), target, args.branch, "Initial commit")
    repo.files.write(f"{schema.FOLDER}/001_init{schema.SUFFIX}", EXAMPLE)
    print(f"Initialized repository at {target}\n  branch: {args.branch}\n  root:   {repo.head()[1].hash}\n  migrations: {target}/{schema.FOLDER}/")


def _commit(args: argparse.Namespace, repo: Repository) -> None:
    message = "commit" if args.message is None else args.message
    if not args.set:
        branch, tip = repo.head()
        made = repo.commit([tip], tip, {}, message)
        repo.update_branch(branch, made)
        repo.flush()
        print(f"commit {made.hash}\n  branch: {branch}")
        return
    payload = {}
    for pair in args.set:
        key, sign, value = pair.partition("=")
        if not key or not sign:
            raise CodecError(f"invalid key=value pair: {pair}")
        payload[key] = Literal("string", value)
    print(Engine(repo).execute_statement(Commit(payload, message)))


def _branch(args: argparse.Namespace, repo: Repository) -> None:
    at = repo.create_branch(args.name, repo.resolve(args.start))
    print(f"created branch '{args.name}' at {at.hash}")


def _checkout(args: argparse.Namespace, repo: Repository) -> None:
    found = repo.checkout(args.target)
    print(f"commit {found['hash']}\n  root_hamt: {found['root_hamt']}\n  message:   {found['message']}")


def _migrate(_: argparse.Namespace, repo: Repository) -> None:
    report = repo.migrate()
    if report.applied:
        print(f"Applied {len(report.applied)} migration(s):", *(f"  {n}" for n in report.applied), sep="\n")
    else:
        print(f"No pending migrations ({len(report.skipped)} already applied).")
    print(f"Schema: {len(report.schema.collections)} collection(s), {len(report.schema.indexes())} index(es)")


def _query(args: argparse.Namespace, repo: Repository) -> None:
    results = Engine(repo).execute(args.source)
    for i, result in enumerate(results, 1):
        if len(results) > 1:
            print(f"--- result {i} ---")
        print(result)


def _serve(args: argparse.Namespace, repo: Repository) -> None:
    from palimpsest.server import Server

    with Server(repo, (args.host, args.port)) as server:
        print(f"listening on {args.host}:{server.server_address[1]}", flush=True)
        server.serve_forever()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="palimpsest", description="Versioned documents on Spark")
    p.add_argument("-C", "--path", default=".", help="the repository or the folder that holds it")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("init")
    one.add_argument("--branch", default="main")
    one = sub.add_parser("commit")
    one.add_argument("-m", "--message")
    one.add_argument("--set", action="append", default=[], metavar="KEY=VALUE")
    one.set_defaults(run=_commit)
    one = sub.add_parser("branch")
    one.add_argument("name")
    one.add_argument("--from", dest="start", default="HEAD")
    one.set_defaults(run=_branch)
    one = sub.add_parser("checkout")
    one.add_argument("target")
    one.set_defaults(run=_checkout)
    one = sub.add_parser("migrate")
    one.add_argument("folder", nargs="?")
    one.set_defaults(run=_migrate)
    one = sub.add_parser("query")
    one.add_argument("source")
    one.set_defaults(run=_query)
    one = sub.add_parser("serve")
    one.add_argument("--host", default="127.0.0.1")
    one.add_argument("--port", type=int, default=7420)
    one.set_defaults(run=_serve)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.command == "init":
            _init(args)
        else:
            args.run(args, Repository(session(), _folder(getattr(args, "folder", None) or args.path)))
    except PalimpsestError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
