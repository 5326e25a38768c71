"""SQL expression builders (JVM-side expressions only) and temporary SQL functions."""

from credlens.functions.registry import register_functions
from credlens.functions.text import (
    fingerprint,
    normalize_newlines,
    redact,
    severity_rank,
    shannon_entropy,
)

__all__ = [
    "fingerprint", "normalize_newlines", "redact", "register_functions",
    "severity_rank", "shannon_entropy",
]
