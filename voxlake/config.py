"""Experiment configuration: strict, declarative checks of a nested mapping.

A section is a table of fields, each with a test and what it must be; unknown and missing fields are
errors.  ``TBD`` anywhere counts as not given.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from pathlib import Path
from typing import Any


class ConfigError(ValueError):
    """A configuration that breaks a rule."""


#: Fixed values of the study.
SEED, TARGETS, SPEED, CONDITIONS, MOST_PSEUDO, EXPERIMENTS = 42, {"q_proj", "v_proj"}, (0.95, 1.05), (0, 10, 25), 0.25, ("E1", "E2", "E3", "pilot")
PILOT_RUNS = ("P1", "P2", "P3")
STRATEGIES = ("steps", "epoch", "no")

Test = tuple[Callable[[Any], bool], str]


def _plain(v) -> bool:
    return isinstance(v, int | float) and not isinstance(v, bool)


def number(low: float, high: float, open_low: bool = False, open_high: bool = False) -> Test:
    ok = lambda v: _plain(v) and (low < v if open_low else low <= v) and (v < high if open_high else v <= high)
    return ok, f"a number from {low} to {high}"


def whole(low: int, high: int | None = None) -> Test:
    return (lambda v: isinstance(v, int) and not isinstance(v, bool) and v >= low and (high is None or v <= high)), f"a whole number from {low}" + (f" to {high}" if high else "")


def exactly(value: Any) -> Test:
    return (lambda v: v == value and isinstance(v, bool) == isinstance(value, bool)), f"{value!r}"


def one_of(*values: Any) -> Test:
    return (lambda v: v in values), "one of " + ", ".join(map(repr, values))


def maybe(test: Test) -> Test:
    return (lambda v: v is None or test[0](v)), test[1] + " or nothing"


text: Test = ((lambda v: isinstance(v, str) and bool(v.strip())), "text")
flag: Test = ((lambda v: isinstance(v, bool)), "true or false")
anything: Test = ((lambda v: True), "anything")

SECTIONS: dict[str, dict[str, Test]] = {
    "experiment": {"name": text, "experiment": one_of(*EXPERIMENTS), "description?": maybe(text)},
    "model": {"id": text, "revision?": maybe(text), "load_in_8bit": exactly(True), "dtype": exactly("float16")},
    "lora": {
        "r": whole(1, 256), "alpha": whole(1, 1024), "dropout": number(0, 0.5),
        "target_modules": ((lambda v: isinstance(v, list) and len(v) == len(set(v)) and set(v) == TARGETS), "exactly q_proj and v_proj"),
    },
    "training": {
        "learning_rate": number(0, 0.1, True, True), "epochs": whole(1, 20), "warmup_ratio": number(0, 0.5), "weight_decay": number(0, 1),
        "per_device_train_batch_size": whole(1, 256), "gradient_accumulation_steps": whole(1, 256), "gradient_checkpointing": flag, "fp16": flag,
        "eval_strategy": one_of(*STRATEGIES), "eval_steps?": maybe(whole(1)), "save_strategy": one_of(*STRATEGIES), "save_steps?": maybe(whole(1)),
        "save_total_limit?": maybe(whole(1)), "logging_steps?": whole(1), "seed": exactly(SEED),
    },
    "splits": {"train": whole(0), "validation": whole(0), "test": whole(0), "seed": exactly(SEED)},
    "dataset": {"id": text, "revision?": maybe(text), "license?": maybe(text), "splits": anything},
    "augmentation": {
        "enabled": flag, "seed": exactly(SEED), "telephone_bandpass_probability": number(0, 0.3), "narrowband_resample_probability": number(0, 0.3),
        "mulaw_alaw_probability": number(0, 0.15), "gain_variation_probability": number(0, 0.2), "clipping_probability": number(0, 0.1),
        "noise_probability": number(0, 0.15), "speed_perturbation_probability": number(0, 0.1),
        "speed_rate_range": ((lambda v: isinstance(v, list | tuple) and tuple(v) == SPEED), "exactly [0.95, 1.05]"), "apply_probability": number(0, 1), "preserve_transcript": exactly(True),
    },
    "telephone_test": {
        "enabled": flag, "seed": exactly(SEED), "reference_resample_khz?": whole(8, 16),
        "bandpass_hz": ((lambda v: isinstance(v, list | tuple) and len(v) == 2 and all(map(_plain, v)) and 200 <= v[0] <= 400 and 3000 <= v[1] <= 4000), "a band from 200-400 to 3000-4000 Hz"),
    },
    "pseudo_labelled": {
        "id": text, "is_pseudo_labelled": exactly(True), "revision?": maybe(text), "license?": maybe(text), "include_percent": one_of(*CONDITIONS),
        "conditions": ((lambda v: isinstance(v, list) and tuple(sorted(v)) == CONDITIONS), "exactly [0, 10, 25]"), "max_fraction_of_primary?": number(0, MOST_PSEUDO),
    },
    "pilot_subset": {"target_hours": number(0, 1e9, True), "validation_examples?": whole(1), "seed?": exactly(SEED)},
}
DEFAULTS = {"training": {"logging_steps": 25}, "telephone_test": {"reference_resample_khz": 8}, "pseudo_labelled": {"max_fraction_of_primary": MOST_PSEUDO}, "pilot_subset": {"validation_examples": 128, "seed": SEED}}
REQUIRED = ("experiment", "model", "lora", "training", "dataset")
OPTIONAL = ("pilot_subset", "pilot_candidates", "augmentation", "telephone_test", "pseudo_labelled")


def replace_tbd(value: Any) -> Any:
    """TBD, wherever it stands, becomes None."""
    if isinstance(value, Mapping):
        return {k: replace_tbd(v) for k, v in value.items()}
    if isinstance(value, list):
        return [replace_tbd(v) for v in value]
    return None if value == "TBD" else value


def check_section(name: str, section: Any) -> dict:
    if not isinstance(section, Mapping):
        raise ConfigError(f"{name} must be a mapping")
    fields = SECTIONS[name]
    names = {f.rstrip("?") for f in fields}
    if unknown := sorted(set(section) - names):
        raise ConfigError(f"{name}: unknown keys: {', '.join(map(str, unknown))}")
    out = {**DEFAULTS.get(name, {}), **section}
    for field, (ok, what) in fields.items():
        key = field.rstrip("?")
        if key not in out:
            if not field.endswith("?"):
                raise ConfigError(f"{name}.{key} is required")
        elif not ok(out[key]):
            raise ConfigError(f"{name}.{key} must be {what}, got {out[key]!r}")
    return out


def validate(config: Any) -> dict:
    """A checked copy of a configuration, or ConfigError."""
    if not isinstance(config, Mapping):
        raise ConfigError("a configuration is a mapping")
    config = replace_tbd(config)
    if missing := [s for s in REQUIRED if s not in config]:
        raise ConfigError(f"missing sections: {', '.join(missing)}")
    if unknown := sorted(set(config) - {*REQUIRED, *OPTIONAL}):
        raise ConfigError(f"unknown sections: {', '.join(map(str, unknown))}")
    out = {name: check_section(name, value) for name, value in config.items() if name in SECTIONS and value is not None}
    splits = check_section("splits", out["dataset"]["splits"])
    out["dataset"] = {**out["dataset"], "splits": splits}
    if splits["train"] + splits["validation"] + splits["test"] != 100:
        raise ConfigError("splits must sum to 100")
    lora, training = out["lora"], out["training"]
    if lora["alpha"] < lora["r"]:
        raise ConfigError("lora.alpha must be at least lora.r")
    for kind in ("eval", "save"):
        if training[f"{kind}_strategy"] == "steps" and training.get(f"{kind}_steps") is None:
            raise ConfigError(f"training.{kind}_steps is required with steps")
    if training["gradient_checkpointing"] and not training["fp16"]:
        raise ConfigError("training.fp16 must be true with gradient_checkpointing")
    if aug := out.get("augmentation"):
        p = aug["apply_probability"]
        if (p != 0) if not aug["enabled"] else not 0.30 <= p <= 0.40:
            raise ConfigError("augmentation.apply_probability must be 0 when disabled, 0.30 to 0.40 when enabled")
    _check_kind(out, config)
    if config.get("pilot_candidates") is not None:
        out["pilot_candidates"] = [dict(c) for c in config["pilot_candidates"]]
    return out


def _check_kind(out: Mapping, config: Mapping) -> None:
    kind, aug, pseudo = out["experiment"]["experiment"], out.get("augmentation"), out.get("pseudo_labelled")
    if kind == "E1" and (not aug or aug["enabled"]):
        raise ConfigError("E1 needs an augmentation section that is disabled")
    if kind == "E2" and not (aug and aug["enabled"]):
        raise ConfigError("E2 needs augmentation")
    if kind == "E3" and not pseudo:
        raise ConfigError("E3 needs the pseudo_labelled section")
    if kind in ("E1", "E2") and pseudo:
        raise ConfigError(f"{kind} must not use pseudo-labelled data")
    if kind == "pilot":
        runs = config.get("pilot_candidates") or []
        if sorted(str(c.get("run")) for c in runs) != list(PILOT_RUNS) or any(not whole(1, 256)[0](c.get("lora_rank")) or not number(0, 0.1, True, True)[0](c.get("learning_rate")) for c in runs):
            raise ConfigError("pilot_candidates must be exactly P1, P2 and P3 with rank and learning rate")


def load(path: str | Path) -> dict:
    path = Path(path)
    if not path.is_file():
        raise ConfigError(f"no configuration at {path}")
    body = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        return validate(json.loads(body))
    import yaml

    return validate(yaml.safe_load(body))


def main(paths: list[str]) -> int:
    for path in paths:
        try:
            load(path)
        except ConfigError as e:
            print(f"{path}: {e}")
            return 1
        print(f"{path}: valid")
    return 0


if __name__ == "__main__":
    import sys

    sys.exit(main(sys.argv[1:]))
