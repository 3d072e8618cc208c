"""What a run was made of: the code's state, the plan and the results, as JSON beside its output."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Mapping
from datetime import datetime, timezone
from pathlib import Path

#: The names of the three files, and what stands for a commit that can't be read.
METADATA, PLAN, METRICS = "experiment_metadata.json", "training_config.json", "metrics.json"
UNKNOWN_COMMIT = "TBD"


def git_state(folder: str | Path = ".") -> tuple[str, bool]:
    """The commit that is checked out, and whether anything differs from it; unknown and differing without git."""
    answers = []
    for command in ("rev-parse HEAD", "status --porcelain"):
        try:
            ran = subprocess.run(["git", "-C", str(folder), *command.split()], capture_output=True, text=True, check=False)
        except OSError:
            return UNKNOWN_COMMIT, True
        if ran.returncode:
            return UNKNOWN_COMMIT, True
        answers.append(ran.stdout.strip())
    return answers[0], bool(answers[1])


def run_metadata(plan: Mapping, training_examples: int, started_at: str | None = None, folder: str | Path = ".") -> dict:
    """A run's identity, from a plan of ``training.training_plan``."""
    commit, differs = git_state(folder)
    return {
        "experiment": plan["experiment"], "git_commit": commit, "git_dirty": differs, "base_model": plan["model"], "base_model_revision": plan["model_revision"],
        "dataset_id": plan["dataset"], "dataset_revision": plan["dataset_revision"], "seed": plan["seed"], "learning_rate": plan["learning_rate"],
        "lora_rank": plan["lora"]["r"], "lora_alpha": plan["lora"]["lora_alpha"], "augmentation": "telephone-v1" if plan["augmentation"].get("enabled") is True else "none",
        "training_examples": training_examples, "started_at": started_at or datetime.now(timezone.utc).isoformat(),
    }


def write_run(folder: str | Path, plan: Mapping, metadata: Mapping, metrics: object) -> list[Path]:
    """The three files, keys sorted; values that JSON doesn't know as text."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    out = []
    for name, content in zip((METADATA, PLAN, METRICS), (metadata, plan, metrics), strict=True):
        out.append(folder / name)
        out[-1].write_text(json.dumps(content, indent=2, sort_keys=True, default=str) + "\n", encoding="utf-8", newline="\n")
    return out
