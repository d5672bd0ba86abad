"""Errors and warnings of requests: a coarse kind, a stable code, a message for people."""

from __future__ import annotations

from dataclasses import dataclass


class RequestError(ValueError):
    def __init__(self, code: str, message: str, kind: str = "INVALID_REQUEST"):
        super().__init__(f"{code}: {message}")
        self.kind, self.code, self.message = kind, code, message


@dataclass(frozen=True)
class Warn:
    code: str
    message: str


def only(keys: dict, allowed: str, what: str) -> None:
    """Unknown keys are errors: a misspelt option never passes unseen."""
    if odd := set(keys) - set(allowed.split()):
        raise RequestError("unknown_key", f"{what} has no {', '.join(sorted(odd))}")
