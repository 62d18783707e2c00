"""Weights of LPIPS trunks by name: one `.npz` a net in a folder, or one file named by the environment.

FRAMESCOPE_LPIPS_WEIGHTS names a single file and overrides the search; FRAMESCOPE_WEIGHTS names the folder that
holds `lpips_<net>.npz`. Both are read on the driver; executors get the arrays by broadcast. No weights are
shipped: published ones have to be brought in the layout that `load` states.
"""

from __future__ import annotations

import os
from functools import lru_cache
from pathlib import Path

import numpy as np

ONE, FOLDER = "FRAMESCOPE_LPIPS_WEIGHTS", "FRAMESCOPE_WEIGHTS"


def available_nets() -> list[str]:
    """Names of the nets in the folder."""
    at = os.environ.get(FOLDER)
    return sorted(p.stem.removeprefix("lpips_") for p in Path(at).glob("lpips_*.npz")) if at and Path(at).is_dir() else []


def path(net: str) -> Path:
    """Where a net's weights are."""
    if one := os.environ.get(ONE):
        if not Path(one).is_file():
            raise FileNotFoundError(f"{ONE}={one!r} is no file")
        return Path(one)
    if net not in available_nets():
        raise FileNotFoundError(f"no weights of {net!r}: {FOLDER} holds {available_nets() or 'none'}; name the folder of lpips_<net>.npz there, or one file in {ONE}")
    return Path(os.environ[FOLDER]) / f"lpips_{net}.npz"


@lru_cache(4)
def _loaded(at: str, changed: int) -> dict:
    with np.load(at) as z:
        version = int(z.get("format_version", 0))
        if version != 1:
            raise ValueError(f"{at} is of format_version {version}, not 1")
        n = len(z["stride"])
        missing = [x for name in ("weight", "bias", "lin") for x in [f"{name}{i}" for i in range(n)] if x not in z] + [x for x in ("padding", "pool_before") if x not in z]
        if missing:
            raise ValueError(f"{at} lacks {missing}")
        each = lambda name: [np.asarray(z[f"{name}{i}"], np.float64) for i in range(n)]
        return {"weight": each("weight"), "bias": each("bias"), "lin": [x.ravel() for x in each("lin")], "stride": z["stride"].tolist(), "padding": z["padding"].tolist(), "pool": z["pool_before"].tolist()}


def load(at: str | Path) -> dict:
    """Trunk weights from an .npz: format_version 1; weight0.., bias0.., lin0.. and the arrays stride, padding
    and pool_before, one entry a layer. A file is read once until it changes."""
    return _loaded(str(at), os.stat(at).st_mtime_ns)


def net(given: dict | str) -> dict:
    """A net as given, or the one of that name."""
    return load(path(given)) if isinstance(given, str) else given
