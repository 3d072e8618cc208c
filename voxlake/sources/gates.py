"""Governance gates of the loaders: checked on the driver, before anything is read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

#: Columns that may hold a transcript, in order of preference.
TRANSCRIPT_COLUMNS = ("transcript", "transcription", "text", "sentence")
EXTERNAL_SPLITS = ("validation", "test")


def check_revision(revision: str | None) -> str:
    """A pinned revision: eight characters or more."""
    cleaned = (revision or "").strip()
    if len(cleaned) < 8:
        raise ValueError("a pinned dataset revision is required")
    return cleaned


def check_limit(limit: int | None) -> None:
    if limit is not None and limit < 0:
        raise ValueError("max_examples must not be negative")


def check_pseudo_opt_in(allow_full_audio: bool, allow_license_use: bool) -> bool:
    """Audio of pseudo-labelled data needs both permissions; one alone is an error."""
    if allow_full_audio != allow_license_use:
        raise PermissionError("full audio of pseudo-labelled data needs both permissions")
    return allow_full_audio


def check_external_split(split: str) -> None:
    if split not in EXTERNAL_SPLITS:
        raise ValueError(f"external evaluation data has only {', '.join(EXTERNAL_SPLITS)}; got {split!r}")


def transcript_column(columns: Sequence[str]) -> str:
    """The first transcript column that is there, whether or not its values are null."""
    for name in TRANSCRIPT_COLUMNS:
        if name in columns:
            return name
    raise ValueError(f"no transcript column among {', '.join(columns)}")


def check_primary(registry: Sequence[Mapping], dataset_id: str) -> Mapping:
    """The registry's entry of a dataset that may be audited: known, and of the primary role."""
    for entry in registry:
        if entry["id"] == dataset_id:
            if entry.get("role") != "primary":
                raise SystemExit(f"{dataset_id} is {entry.get('role')!r}, not primary")
            return entry
    raise SystemExit(f"{dataset_id} is not in the registry")
