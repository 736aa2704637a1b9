"""What a run notes about where and with what it ran. Best effort: what can't be had is None."""

from __future__ import annotations

import os
import platform
import socket
import subprocess
from importlib import metadata

from .functions.hashing import md5
from .names import StoreError

WATCHED = ("pyspark", "pyarrow", "pandas", "numpy")


def _memory(key: str) -> int | None:
    try:
        with open("/proc/meminfo") as f:
            return next(int(x.split()[1]) * 1024 for x in f if x.startswith(key))
    except (OSError, StopIteration):
        return None


def session(spark) -> dict:
    packages = []
    for p in WATCHED:
        try:
            packages.append({"pkg": p, "ver": metadata.version(p)})
        except metadata.PackageNotFoundError:
            continue
    return {
        "hostname": socket.gethostname(), "os": platform.platform(), "arch": platform.machine(), "runtime_version": f"python {platform.python_version()}, spark {spark.version}",
        "n_cpu": os.cpu_count(), "total_ram_bytes": _memory("MemTotal"), "free_ram_bytes": _memory("MemAvailable"), "attached_packages": packages,
    }


def git() -> dict:
    def ask(*words: str) -> str | None:
        try:
            done = subprocess.run(["git", *words], capture_output=True, text=True, timeout=5, check=False)
        except (OSError, subprocess.TimeoutExpired):
            return None
        return done.stdout.strip() if done.returncode == 0 else None

    dirty = ask("status", "--porcelain")
    return {"git_sha": ask("rev-parse", "HEAD"), "git_branch": ask("rev-parse", "--abbrev-ref", "HEAD"), "git_dirty": None if dirty is None else bool(dirty)}


def external(files=(), env=()) -> dict:
    """Hashes of declared files (each must be there) and environment variables (null if unset)."""
    out = []
    for path in files:
        try:
            with open(path, "rb") as f:
                out.append({"path": str(path), "hash": md5(f.read())})
        except OSError:
            raise StoreError(f"external input {path} can't be read") from None
    return {"files": out, "env": [{"name": n, "hash": md5(os.environ[n]) if n in os.environ else None} for n in env]}
