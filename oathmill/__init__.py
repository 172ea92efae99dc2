"""Affidavit analytics as declarative Spark plans."""

from __future__ import annotations

import os
from pathlib import Path


def reach_workers(spark) -> None:
    """Let Python workers that the session starts from now on import this package from where the driver has it, whatever
    folder they start in. On a cluster without that folder this does nothing; ship the package with the job there."""
    root, known = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([*paths, root])
