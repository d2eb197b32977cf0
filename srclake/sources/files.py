"""SNK-6, SNK-7, PAT-9: driver-side writes of patched files. The result is a row, never an exception."""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
import time


def write_patched(root: str, rel_path: str, text: str, backup: bool = True) -> dict:
    """SNK-6: the file replaced, its old content kept beside it under a timestamp; a file that is missing or outside the root is a
    failure."""
    path = os.path.realpath(os.path.join(root, rel_path))
    if not path.startswith(os.path.realpath(root) + os.sep):
        return {"success": False, "target_file": rel_path, "backup": None, "error": "outside the repository"}
    if not os.path.isfile(path):
        return {"success": False, "target_file": rel_path, "backup": None, "error": "no such file"}
    try:
        kept = None
        if backup:
            kept = f"{path}.{time.strftime('%Y%m%d%H%M%S')}.bak"
            shutil.copy2(path, kept)
        with open(path, "w", encoding="utf-8", newline="") as f:
            f.write(text)
    except OSError as e:
        return {"success": False, "target_file": rel_path, "backup": None, "error": str(e)}
    return {"success": True, "target_file": rel_path, "backup": kept, "error": None}


def apply_diff(root: str, diff: str, check_only: bool = False, timeout: int = 15) -> dict:
    """SNK-7, PAT-9: a unified diff through git, or only a dry run; where git is missing it counts as valid and skipped."""
    if not diff or not diff.strip():
        return {"valid": False, "skipped": False, "error": "Empty diff"}
    with tempfile.NamedTemporaryFile("w", suffix=".patch", encoding="utf-8") as f:
        f.write(diff if diff.endswith("\n") else diff + "\n")
        f.flush()
        try:
            done = subprocess.run(["git", "apply", "--whitespace=nowarn", *["--check"] * check_only, f.name], cwd=root, capture_output=True, text=True, timeout=timeout)
        except FileNotFoundError:
            return {"valid": True, "skipped": True, "error": None}
        except (subprocess.TimeoutExpired, OSError) as e:
            return {"valid": False, "skipped": False, "error": str(e)}
    return {"valid": done.returncode == 0, "skipped": False, "error": None if done.returncode == 0 else done.stderr.strip() or "git apply failed"}
