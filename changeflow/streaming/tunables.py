"""Row thresholds a running job reads again before each batch."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from changeflow.sinks.files import Folder

LOWEST, HIGHEST = 1_000, 10_000_000
NAME = "tunables"


@dataclass(frozen=True)
class Tunables:
    chunk_target_rows: int = 50_000
    merge_threshold_rows: int = 30_000
    split_threshold_rows: int = 100_000


def clamp(rows: int) -> int:
    """The range an update may set."""
    return min(max(rows, LOWEST), HIGHEST)


def load(folder: Folder, default: Tunables = Tunables()) -> Tunables:
    """The newest stored values, at least 1 each; ``default`` where none are stored."""
    files = [n for n in folder.names() if n.startswith(NAME)]
    if not files:
        return default
    stored = json.loads(folder.read(max(files)))
    values = {k: max(int(stored.get(k, v)), 1) for k, v in asdict(default).items()}
    return Tunables(**values)


def update(folder: Folder, **changes: int) -> Tunables:
    """Store changed values, clamped; a job that runs picks them up with its next batch."""
    values = {**asdict(load(folder)), **{k: clamp(v) for k, v in changes.items() if v is not None}}
    new = Tunables(**values)
    number = sum(n.startswith(NAME) for n in folder.names())
    folder.create(f"{NAME}-{number:010d}.json", json.dumps(asdict(new)))
    return new
