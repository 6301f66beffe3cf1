"""Files and folders that appear whole or not at all, for readers that may come at any time."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable
from pathlib import Path


def there(path: str | Path) -> bool:
    """Whether something was published here; an empty file doesn't count."""
    try:
        return os.stat(path).st_size > 0
    except OSError:
        return False


def published(target: Path, make: Callable[[Path], object]) -> None:
    """What make() leaves under a name of its own beside target, under target's name. A folder that another task has
    published meanwhile stays; a file is replaced. If make() fails nothing is left."""
    target.parent.mkdir(parents=True, exist_ok=True)
    own = target.with_name(f".{uuid.uuid4().hex}-{target.name}")
    try:
        make(own)
        try:
            own.replace(target)
        except OSError:
            if not (own.is_dir() and target.is_dir()):
                raise
    finally:
        if own.is_dir():
            shutil.rmtree(own, ignore_errors=True)
        else:
            own.unlink(missing_ok=True)
