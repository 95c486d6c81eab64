"""Declared collections and indexes, their text form, and migrations."""

from __future__ import annotations

from dataclasses import dataclass, field

from palimpsest.errors import ParseError
from palimpsest.language.parser import TYPES, parse_migration
from palimpsest.language.syntax import CreateCollection, CreateIndex, Migration
from palimpsest.sources.files import Files

STATE, LOCK, FOLDER, SUFFIX = "schema.state", "schema.lock", "migrations", ".eql"


@dataclass
class Index:
    name: str
    path: str
    type: str


@dataclass
class Collection:
    """A primary key of (path, type) fields, and indexes."""

    name: str
    keys: list[tuple[str, str]] = field(default_factory=list)
    indexes: list[Index] = field(default_factory=list)


def index_name(collection: str, path: str) -> str:
    return f"{collection}.by_{path.replace('.', '_')}"


@dataclass
class Registry:
    """All collections by name."""

    collections: dict[str, Collection] = field(default_factory=dict)

    def apply(self, statement: Migration) -> None:
        """Changes the registry by one statement."""
        if isinstance(statement, CreateCollection):
            if statement.name in self.collections:
                raise ParseError(f"collection '{statement.name}' already exists")
            self.collections[statement.name] = Collection(statement.name, list(statement.keys))
            return
        collection = self.collections.get(statement.collection)
        if collection is None:
            raise ParseError(f"unknown collection '{statement.collection}'")
        name = index_name(statement.collection, statement.path)
        if isinstance(statement, CreateIndex):
            if any(i.name == name for i in collection.indexes):
                raise ParseError(f"index '{name}' already exists")
            collection.indexes.append(Index(name, statement.path, statement.type))
            return
        kept = [i for i in collection.indexes if name != i.name and statement.path != i.path]
        if len(kept) == len(collection.indexes):
            raise ParseError(f"index on '{statement.collection}.{statement.path}' not found")
        collection.indexes = kept

    def indexes(self) -> list[tuple[Collection, Index]]:
        return [(c, i) for _, c in sorted(self.collections.items()) for i in c.indexes]

    def dump(self) -> str:
        """The registry as lines: COLLECTION name, KEY path type, INDEX name PATH path TYPE type."""
        lines = []
        for _, c in sorted(self.collections.items()):
            lines.append(f"COLLECTION {c.name}")
            lines += [f"KEY {path} {kind}" for path, kind in c.keys]
            lines += [f"INDEX {i.name} PATH {i.path} TYPE {i.type}" for i in c.indexes]
        return "".join(f"{line}\n" for line in lines)


def load(text: str) -> Registry:
    """The registry of ``dump``'s lines; # begins a comment line."""
    out = Registry()
    current: Collection | None = None
    for number, line in enumerate(text.splitlines(), 1):

        def need(ok: object, why: str, number: int = number) -> None:
            if not ok:
                raise ParseError(f"{STATE} line {number}: {why}")

        words = line.split()
        if not words or words[0].startswith("#"):
            continue
        if words[0] == "COLLECTION":
            need(len(words) > 1, "expected collection name")
            current = out.collections.setdefault(words[1], Collection(words[1]))
        elif words[0] == "KEY":
            need(current, "KEY outside COLLECTION")
            need(len(words) > 1, "expected KEY path")
            need(len(words) > 2, "expected KEY type")
            need(words[2].upper() in TYPES, f"unknown type '{words[2]}'")
            current.keys.append((words[1], words[2].upper()))  # type: ignore[union-attr]
        elif words[0] == "INDEX":
            need(len(words) > 1, "expected INDEX name")
            need(words[2:3] == ["PATH"], "expected PATH after index name")
            need(len(words) > 3, "expected index path")
            need(words[4:5] == ["TYPE"], "expected TYPE after path")
            need(len(words) > 5, "expected type")
            need(words[5].upper() in TYPES, f"unknown type '{words[5]}'")
            owner = out.collections.get(words[1].partition(".by_")[0])
            need(".by_" in words[1] and owner is not None, "invalid index name")
            owner.indexes.append(Index(words[1], words[3], words[5].upper()))  # type: ignore[union-attr]
        else:
            need(False, f"unknown directive '{words[0]}'")
    return out


@dataclass
class Report:
    """What a run of migrations did."""

    applied: list[str]
    skipped: list[str]
    schema: Registry


def current(files: Files) -> Registry:
    """The registry of a repository."""
    return load(files.read(STATE)) if files.exists(STATE) else Registry()


def migrate(files: Files) -> Report:
    """Applies the migration files not yet applied, in order of name; all of them or none."""
    registry = current(files)
    done = files.read(LOCK).split("\n") if files.exists(LOCK) else []
    done = [x.strip() for x in done if x.strip() and not x.startswith("#")]
    names = [n for n in files.names(FOLDER) if n.endswith(SUFFIX)]
    fresh = [n for n in names if n not in done]
    for name in fresh:
        for statement in parse_migration(files.read(f"{FOLDER}/{name}")):
            registry.apply(statement)
    if fresh:
        files.write(STATE, registry.dump())
        files.write(LOCK, "".join(f"{n}\n" for n in [*done, *fresh]))
    return Report(fresh, [n for n in names if n in done], registry)
