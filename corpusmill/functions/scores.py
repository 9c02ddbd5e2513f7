"""Score-vector expressions (F4-F6, F8, F12, F14) on array columns, kept in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def logsumexp(scores) -> Column:
    """Stable ``log(sum(exp(x)))`` of a numeric array."""
    s = _c(scores).cast("array<double>")
    m = F.array_max(s)
    total = F.aggregate(s, F.lit(0.0), lambda acc, x: acc + F.exp(x - m))
    return m + F.log(total)


def log_softmax(scores) -> Column:
    """``log_softmax`` of a score vector, shifted by its max for stability."""
    s = _c(scores).cast("array<double>")
    lse = logsumexp(s)
    return F.transform(s, lambda x: x - lse)


def target_logprob(scores, target) -> Column:
    """Log-probability of ``target`` (0-based index) under ``log_softmax(scores)``."""
    s = _c(scores).cast("array<double>")
    return F.get(s, _c(target)) - logsumexp(s)


def perplexity_str(mean_loss) -> Column:
    """``exp`` of a mean loss printed with two decimals."""
    return F.format_string("%.2f", F.exp(_c(mean_loss)))


def ones_mask(ids) -> Column:
    """All-ones attention mask for one unpadded prompt."""
    return F.array_repeat(F.lit(1), F.size(_c(ids)))


def right_pad(ids, length, pad_id) -> Column:
    """Right-pad ``ids`` to ``length`` with ``pad_id``."""
    return F.concat(_c(ids), F.array_repeat(F.lit(pad_id).cast("bigint"), _c(length) - F.size(_c(ids))))


def length_mask(size, length) -> Column:
    """1 for the first ``size`` positions, 0 for the padding up to ``length``."""
    return F.concat(F.array_repeat(F.lit(1), _c(size)), F.array_repeat(F.lit(0), _c(length) - _c(size)))


def clamp(x, lo, hi) -> Column:
    return F.least(F.greatest(_c(x), _c(lo)), _c(hi))
