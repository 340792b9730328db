"""Content-addressed, sealed directories on the driver's file system."""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import platform
import subprocess
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from massflow.sources.files import json_safe, write_json

INVENTORY = "checksums.json"


def identity(value) -> str:
    """SHA-256 of the sorted compact JSON of a value."""
    return hashlib.sha256(json.dumps(json_safe(value), sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def artifact_id(value) -> str:
    return identity(value)[:20]


def sha256(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def inventory(root: Path) -> dict[str, str]:
    """Hash of every file under ``root`` but the inventory; a symlink is an error."""
    out = {}
    for p in sorted(root.rglob("*")):
        if p.is_symlink():
            raise ValueError(f"a sealed directory holds a symlink: {p}")
        if p.is_file() and p != root / INVENTORY:
            out[p.relative_to(root).as_posix()] = sha256(p)
    return out


def seal(root: str | Path) -> str:
    """Writes the inventory (after all other files) and returns its identity."""
    root = Path(root)
    files = inventory(root)
    write_json(root / INVENTORY, files)
    return identity(files)


def verify(root: str | Path) -> str:
    """The identity of a sealed directory; extra, missing and changed files fail."""
    root = Path(root)
    want = json.loads((root / INVENTORY).read_text())
    have = inventory(root)
    wrong = sorted({k for k in want.keys() | have.keys() if want.get(k) != have.get(k)})
    if wrong:
        raise ValueError(f"the sealed directory has changed: {', '.join(wrong[:5])}")
    return identity(want)


def verify_subset(root: str | Path, suffixes: tuple[str, ...] = (".json", ".npz", ".parquet")) -> None:
    """The lenient check of older seals: listed data files must be as sealed."""
    root = Path(root)
    for name, digest in json.loads((root / INVENTORY).read_text()).items():
        if name.endswith(suffixes) and (not (root / name).is_file() or sha256(root / name) != digest):
            raise ValueError(f"the sealed directory has changed: {name}")


@contextmanager
def locked(path: str | Path) -> Iterator[None]:
    """An advisory lock held while the block runs."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        yield


def sources() -> dict[str, str]:
    """The hash of every module of this package but the optional ones."""
    root = Path(__file__).resolve().parents[1]
    found = {p.relative_to(root).as_posix(): p for p in sorted(root.rglob("*.py"))}
    return {name: sha256(p) for name, p in found.items() if not name.startswith("llm/")}


def provenance(repo: str | Path | None = None) -> dict:
    """Versions, and the commit of a working tree with a hash of its changes, files
    that are not tracked included."""
    import numpy
    import pandas
    import pyarrow
    import pyspark

    out = {"python": platform.python_version(), "numpy": numpy.__version__, "pandas": pandas.__version__, "pyarrow": pyarrow.__version__, "pyspark": pyspark.__version__, "machine": platform.machine()}
    if repo is not None:
        git = lambda *a: subprocess.run(["git", "-C", str(repo), *a], capture_output=True, text=True).stdout
        new = [n for n in git("ls-files", "--others", "--exclude-standard", "-z").split("\0") if n]
        loose = {n: sha256(Path(repo) / n) for n in new if (Path(repo) / n).is_file()}
        out |= {"commit": git("rev-parse", "HEAD").strip() or None, "changes": identity([git("diff", "HEAD"), loose])}
    return out


@contextmanager
def publish(target: str | Path) -> Iterator[Path]:
    """A temporary directory that becomes ``target``, sealed, if the block ends
    well; an existing target is an error."""
    target = Path(target)
    if target.exists():
        raise FileExistsError(target)
    tmp = target.with_name(f".{target.name}.{os.getpid()}")
    tmp.mkdir(parents=True)
    try:
        yield tmp
        seal(tmp)
        os.rename(tmp, target)
    finally:
        if tmp.exists():
            subprocess.run(["rm", "-rf", str(tmp)], check=False)
