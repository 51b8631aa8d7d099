"""The state of a git work tree. Unknown (no git, no repository, no such revision) is None, never empty."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession

#: Seconds that a git command may take.
PATIENCE = 30


def _git(root: str, *words: str) -> str | None:
    try:
        done = subprocess.run(["git", "-C", root, *words], capture_output=True, text=True, timeout=PATIENCE, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def state(root: str) -> tuple[str | None, bool | None]:
    """The revision checked out, and whether anything differs from it; each None if unknown."""
    revision, status = _git(root, "rev-parse", "HEAD"), _git(root, "status", "--porcelain")
    return revision and revision.strip(), None if status is None else bool(status.strip())


def changed(spark: SparkSession, root: str, since: str = "HEAD") -> DataFrame | None:
    """path of the files that differ from a revision, with untracked ones; None if that can't be known."""
    if since.startswith("-"):
        raise ValueError(f"{since!r} is no revision")
    known, other = _git(root, "diff", "--name-only", "-z", "--relative", since, "--"), _git(root, "ls-files", "-z", "--others", "--exclude-standard")
    if known is None or other is None:
        return None
    paths = sorted({p for p in (known + other).split("\0") if p})
    return spark.createDataFrame([(p,) for p in paths], "path string")
