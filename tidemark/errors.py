"""Typed errors: one class a status that callers can tell apart."""

from __future__ import annotations


class TidemarkError(Exception):
    status = "INTERNAL_ERROR"
    retryable = False


class BadRequest(TidemarkError, ValueError):
    status = "BAD_REQUEST"


class SchemaMismatch(TidemarkError, ValueError):
    status = "SCHEMA_MISMATCH"


class Overloaded(TidemarkError):
    """Too many runs wait to be sunk, or a result is over its limit. Nothing was written or cut off."""

    status = "OVERLOADED"
    retryable = True


class ShuttingDown(TidemarkError):
    status = "SHUTTING_DOWN"
    retryable = True


class LookupUnavailable(TidemarkError):
    """The base could not be read: the answer is unknown, which is not a miss."""

    status = "LOOKUP_UNAVAILABLE"
    retryable = True


class WriterFenced(TidemarkError):
    """Another writer has the table: this one must not publish any more."""

    status = "SHUTTING_DOWN"


class NotSupported(TidemarkError):
    status = "NOT_SUPPORTED"


STATUSES = ("OK", "BAD_REQUEST", "OVERLOADED", "SCHEMA_MISMATCH", "SHUTTING_DOWN", "INTERNAL_ERROR", "LOOKUP_UNAVAILABLE")
