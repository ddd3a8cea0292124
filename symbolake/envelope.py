"""The one JSON object that a command prints, and its exit codes."""

from __future__ import annotations

import json
import sys

from symbolake.model import ENVELOPE_VERSION

# Exit codes.
OK, ERROR, NEEDS_USER = 0, 1, 2


class Failure(Exception):
    """What ends a command: a message and an exit code."""

    def __init__(self, message: str, code: int = NEEDS_USER):
        super().__init__(message)
        self.code = code


def show(command: str, ok: bool, **payload) -> None:
    """ASCII only, so that any console and any reader agrees on the bytes."""
    print(json.dumps({"command": command, "schema_version": ENVELOPE_VERSION, "ok": ok, **payload}, indent=2, ensure_ascii=True))


def fail(command: str, message: str, as_json: bool) -> None:
    if as_json:
        show(command, False, error=message)
    else:
        print(message, file=sys.stderr)
