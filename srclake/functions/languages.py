"""Languages by file extension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension -> language. The core tier is what a scan reads; the extended tier adds the rest.
CORE = {".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".go": "go", ".cpp": "cpp", ".c": "c", ".rs": "rust"}
EXTENDED = CORE | {".jsx": "javascript", ".tsx": "typescript", ".cc": "cpp", ".cxx": "cpp", ".h": "cpp", ".hpp": "cpp", ".cs": "csharp"}
#: Suffixes tried in this order for a file to be patched; none of them means python.
PATCH = {".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".go": "go", ".cpp": "cpp", ".cs": "csharp", ".rb": "ruby", ".rs": "rust"}


def detect(path: Column | str, tier: str = "core") -> Column:
    """SRC-3, SRC-4: case-sensitive lookup of the last extension of the base name, else 'unknown'."""
    c = F.col(path) if isinstance(path, str) else path
    table = CORE if tier == "core" else EXTENDED
    extension = F.regexp_extract(c, r"[^/\\.][^/\\]*?(\.[^./\\]*)$", 1)
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(lookup[extension], F.lit("unknown"))


def detect_for_patch(path: Column | str) -> Column:
    """SRC-5."""
    c = F.col(path) if isinstance(path, str) else path
    out = F.lit("python")
    for suffix, language in reversed(PATCH.items()):
        out = F.when(c.endswith(suffix), language).otherwise(out)
    return out
