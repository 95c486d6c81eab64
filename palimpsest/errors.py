"""Errors of the library, by where they arise."""

from __future__ import annotations


class PalimpsestError(Exception):
    """Any error of the library."""


class ParseError(PalimpsestError):
    """Text that isn't a statement; line and column from 1 where known."""

    def __init__(self, message: str, line: int | None = None, column: int | None = None):
        self.message, self.line, self.column = message, line, column
        super().__init__(f"parse error at {line}:{column}: {message}" if line else f"parse error: {message}")


class ExecutionError(PalimpsestError):
    """A statement that can't be carried out."""


class StoreError(PalimpsestError):
    """A repository that lacks what was asked for."""


class CommitNotFound(StoreError):
    def __init__(self, commit: str):
        super().__init__(f"commit not found: {commit}")


class BranchNotFound(StoreError):
    def __init__(self, name: str):
        super().__init__(f"branch not found: {name}")


class BranchExists(StoreError):
    def __init__(self, name: str):
        super().__init__(f"branch already exists: {name}")


class InvalidTarget(StoreError):
    def __init__(self, target: str):
        super().__init__(f"invalid checkout target: {target}")


class InvalidCommit(StoreError):
    def __init__(self, why: str):
        super().__init__(f"invalid commit: {why}")


class InputOutputError(StoreError):
    def __init__(self, why: str):
        super().__init__(f"io error: {why}")


class CodecError(StoreError):
    def __init__(self, why: str):
        super().__init__(f"codec error: {why}")


class StorageError(StoreError):
    """The store's files are damaged or incomplete."""

    def __init__(self, why: str):
        super().__init__(f"storage error: {why}")


class ObjectNotFound(StorageError):
    def __init__(self, digest: str):
        super().__init__(f"object not found: {digest}")


class HashMismatch(StorageError):
    def __init__(self, expected: str, computed: str):
        super().__init__(f"hash mismatch: expected {expected}, computed {computed}")


class ChecksumMismatch(StorageError):
    def __init__(self) -> None:
        super().__init__("crc mismatch")


class CorruptRecord(StorageError):
    def __init__(self, why: str):
        super().__init__(f"corrupt record: {why}")
