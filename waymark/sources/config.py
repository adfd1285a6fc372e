"""Settings: text with ${NAME} and ${NAME:-default}, and names for folders."""

from __future__ import annotations

import hashlib
import os
import re
from datetime import UTC, datetime

_SLUG = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*")


def expand(text: str, env: dict[str, str] | None = None) -> str:
    """Text with ${NAME} and ${NAME:-default} replaced from the environment.

    An empty variable counts as unset, an unset one without default is an error. What isn't closed, or whose name has other
    characters than capitals, digits and underscores, stays as it is.
    """
    known = os.environ if env is None else env
    before, *marked = text.split("${")
    out = [before]
    for piece in marked:
        inside, closed, after = piece.partition("}")
        name, has_default, default = inside.partition(":-")
        if not (closed and name.isidentifier() and name.isascii() and name == name.upper()):
            out.append("${" + piece)
        elif known.get(name) or has_default:
            out.append((known.get(name) or default) + after)
        else:
            raise KeyError(f"{name} is not set")
    return "".join(out)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def slug(name: str) -> str:
    if not _SLUG.fullmatch(name):
        raise ValueError(f"not a name for a folder: {name!r}")
    return name


def run_id(now: datetime | None = None) -> str:
    return (now or datetime.now(UTC)).strftime("%Y%m%dT%H%M%SZ")
