"""Remote repositories: address parsing and a shallow clone or fast-forward on the driver."""

from __future__ import annotations

import re
import subprocess
from pathlib import Path

from codelode.functions import fixed


def parse(url: str, host: str = r"github\.com") -> str | None:
    """P18 for one address."""
    patterns = (fixed.REPOSITORY.replace("{host}", host), fixed.SHORT_REPOSITORY)
    return next((m[1] for p in patterns if (m := re.match(p, url.strip()))), None)


def fetch(url: str, into: str, host: str = "github.com", clone_seconds: int = 300, pull_seconds: int = 120) -> Path:
    """Clone with depth 1, or pull where there is a clone; a pull that can't fast-forward leaves the clone as it is."""
    name = parse(url, re.escape(host))
    if name is None:
        raise ValueError(f"not the address of a repository: {url}")
    target = Path(into) / name.replace("/", "__")
    if (target / ".git").exists():
        subprocess.run(["git", "-C", str(target), "pull", "--ff-only"], capture_output=True, timeout=pull_seconds, check=False)
    else:
        target.parent.mkdir(parents=True, exist_ok=True)
        subprocess.run(["git", "clone", "--depth", "1", f"https://{host}/{name}.git", str(target)], capture_output=True, timeout=clone_seconds, check=True)
    return target
