"""Settings from a file of KEY=VALUE lines."""

from __future__ import annotations

import os
from collections.abc import MutableMapping


def load_env(path: str, env: MutableMapping[str, str] | None = None) -> dict[str, str]:
    """Set what the file names and ``env`` (the process environment) lacks; comments and blank lines count for nothing.

    A missing file sets nothing. Returns what was set.
    """
    env = os.environ if env is None else env
    made: dict[str, str] = {}
    if not os.path.exists(path):
        return made
    with open(path, encoding="utf-8") as f:
        for line in map(str.strip, f):
            key, eq, value = line.partition("=")
            if eq and not line.startswith("#") and key.strip() not in env:
                env[key.strip()] = made[key.strip()] = value.strip().strip("'\"")
    return made
