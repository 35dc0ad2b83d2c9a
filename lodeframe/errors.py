"""Errors with the codes that callers see."""

from __future__ import annotations


class EngineError(Exception):
    def __init__(self, code: str, message: str, details: dict | None = None):
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.details = code, message, details or {}
