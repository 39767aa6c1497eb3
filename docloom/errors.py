"""Errors: one base class with a numeric code."""

from __future__ import annotations


class DocError(Exception):
    """Any error of this library; ``code`` is a number where one is customary."""

    def __init__(self, message: str, code: int | None = None):
        super().__init__(message)
        self.code = code


class CompileError(DocError):
    """A document of one of the languages is malformed or uses something unsupported."""

    def __init__(self, message: str, code: int | None = 9):
        super().__init__(message, code)


class DuplicateKey(DocError):
    """An ``_id`` or a unique index already holds the value; results so far are attached."""

    def __init__(self, message: str, result: dict | None = None):
        super().__init__(message, 11000)
        self.result = result or {}


class WriteRefused(DocError):
    """A matched document does not allow the update; nothing was written."""
