"""Settings of an engine: identity, scope, fingerprint, checks, and reading them from an environment."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from .errors import EngineError

#: What the names of environment variables begin with.
PREFIX = "LODEFRAME_"


def git_branch(root: str) -> str | None:
    """The branch that is checked out at a root or above it; null if it is detached, none, or out of reach."""
    if "://" in root and not root.startswith("file://"):
        return None
    at = Path(re.sub("^file://", "", root)).resolve()
    for folder in (at, *at.parents):
        head = folder / ".git" / "HEAD"
        try:
            found = re.fullmatch(r"ref: refs/heads/(.+)", head.read_text().strip())
        except OSError:
            continue
        return found[1] if found else None
    return None


@dataclass(frozen=True)
class Config:
    root: str
    home: str
    project: str | None = None
    branch_aware: bool = False
    branch: str | None = None
    ignore: tuple[str, ...] = ()
    ignore_files: tuple[str, ...] = (".gitignore",)
    extended_extensions: bool = False
    max_bytes: int = 1_000_000
    skip_oversize: bool = True
    context: int = 2048
    margin: int = 400
    max_tokens: int | None = None
    overlap_tokens: int = 100
    split_depth: int = 4
    split_policy: str = "split"
    dims: int = 16
    embed_batch: int = 16
    #: Most symbols of a file that are paired with each other; a file beyond it fails and is counted.
    pair_symbols: int = 5_000
    log_level: str = "info"
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        positive = ("max_bytes", "context", "split_depth", "dims", "embed_batch", "pair_symbols", *(("max_tokens",) if self.max_tokens is not None else ()))
        for name in positive:
            if not isinstance(getattr(self, name), int) or getattr(self, name) <= 0:
                raise EngineError("INVALID_CONFIG", f"{name} must be a positive integer")
        if min(self.margin, self.overlap_tokens) < 0:
            raise EngineError("INVALID_CONFIG", "the margin and the overlap must not be negative")
        if self.split_policy not in ("split", "skip"):
            raise EngineError("INVALID_CONFIG", "split_policy is split or skip")
        if self.log_level not in ("debug", "info", "warn", "error"):
            raise EngineError("INVALID_CONFIG", "log_level is debug, info, warn or error")
        if self.margin >= self.context:
            raise EngineError("INVALID_CONFIG", "the margin must be below the context")
        if self.max_tokens is not None and self.max_tokens > self.context - self.margin:
            raise EngineError("INVALID_CONFIG", "chunks must fit the context less its margin")

    @classmethod
    def from_env(cls, root: str, home: str, env: Mapping[str, str] | None = None) -> Config:
        """Settings from variables named like the fields, in capitals behind the prefix; blank ones keep the default. Lists are separated by commas."""
        env, given = os.environ if env is None else env, {}
        for f in fields(cls):
            text = env.get(PREFIX + f.name.upper(), "").strip()
            if not text or f.name in ("root", "home", "extra"):
                continue
            kind = str(f.type)
            try:
                given[f.name] = int(text) if "int" in kind else text.lower() == "true" if "bool" in kind else tuple(x.strip() for x in text.split(",") if x.strip()) if "tuple" in kind else text
            except ValueError as e:
                raise EngineError("INVALID_CONFIG", f"{PREFIX}{f.name.upper()} must be an integer") from e
        return cls(root, home, **given)

    @property
    def scope(self) -> str:
        return "branch" if self.branch_aware and not self.project else "shared"

    @property
    def identity(self) -> str:
        """The project's name, else one made of its root, with the branch if the index is aware of branches."""
        if self.project:
            return self.project
        base = hashlib.sha256(self.root.encode()).hexdigest()[:16]
        name = re.sub(r"^-+|-+$", "", re.sub(r"[^a-zA-Z0-9._-]+", "-", (self.branch or git_branch(self.root) or "") if self.branch_aware else "")).lower()
        return f"{base}__{name}" if name else base

    @property
    def fingerprint(self) -> str:
        kept = {k: v for k, v in asdict(self).items() if k != "log_level"}
        return hashlib.sha256(json.dumps(kept, sort_keys=True, default=str).encode()).hexdigest()[:16]
