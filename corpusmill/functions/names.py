"""Name expressions for run artifacts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The artifact-name patterns of the latest-version rule.
NUMBERED = r".*-(\d+)\.ckpt"
EPOCH_STEP = r"epoch=(\d+)-step=(\d+)\.ckpt"
LAST_NAME = "last.ckpt"
SUFFIX = ".ckpt"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def number_from(name, pattern: str, group: int = 1) -> Column:
    """Integer captured by ``pattern`` (regex search), or null when it does not match.

    ``regexp_extract`` yields '' on no match, and an ANSI cast of '' raises: ``try_cast``.
    """
    return F.regexp_extract(_c(name), pattern, group).try_cast("bigint")


def zero_pad(step, width: int = 6) -> Column:
    """``f"{step:0{width}d}"``."""
    return F.format_string(f"%0{width}d", _c(step))
