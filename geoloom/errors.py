"""Typed errors; each carries what a caller needs to recover."""

from __future__ import annotations


class EngineError(Exception):
    status = 400

    def __init__(self, message: str, **details):
        super().__init__(message)
        self.details = details

    def payload(self) -> dict:
        return {"error": type(self).__name__, "message": str(self), **self.details}


class QuerySpecError(EngineError):
    """A query document that does not hold together."""


class NotFoundError(EngineError):
    status = 404


class DataUnavailableError(EngineError):
    status = 503
