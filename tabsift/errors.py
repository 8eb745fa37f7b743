"""Errors raised by tabsift, each carrying a stable code."""

from __future__ import annotations

# The codes callers match on.
NOT_FOUND = "NOT_FOUND"
UNKNOWN_FORMAT = "UNKNOWN_FORMAT"
MIXED_FORMATS = "MIXED_FORMATS"
NOT_TABULAR = "NOT_TABULAR"
VALIDATION_FAILED = "VALIDATION_FAILED"
UNKNOWN_FILTER = "UNKNOWN_FILTER"
UNKNOWN_ANALYSIS = "UNKNOWN_ANALYSIS"
UNKNOWN_OUTPUT_FORMAT = "UNKNOWN_OUTPUT_FORMAT"
UNKNOWN_JOB_KIND = "UNKNOWN_JOB_KIND"


class TabsiftError(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code
        self.message = message


def invalid(problems: list[str]) -> TabsiftError:
    return TabsiftError(VALIDATION_FAILED, "; ".join(problems))
