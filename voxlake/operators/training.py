"""Data operators of training runs: subsets, stop rules, checkpoints, plans."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.storage import written

#: Files that make a checkpoint complete.
CHECKPOINT_FILES = ("adapter_config.json", "adapter_model.safetensors", "optimizer.pt", "scheduler.pt", "trainer_state.json")


def seeded_order(seed: int, key: str = "sample_id") -> Column:
    """A place in shuffled order that depends on seed and ID alone."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)


def to_target_seconds(rows: DataFrame, target: float, order: tuple[str, ...] = ("index", "sample_id"), seconds: str = "seconds", seed: int | None = None) -> DataFrame:
    """Rows in order until their running total reaches the target; the row that crosses it is included, and the first
    row always.  With a seed the order is shuffled (``seeded_order``), then ``order``.

    Ranges of the order are stored once, so that totals by range and rows inside a range see the same ranges.
    """
    columns = rows.columns
    if seed is not None:
        rows, order = rows.withColumn("_place", seeded_order(seed)), ("_place", *order)
    ranges = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    placed = written(rows.repartitionByRange(int(ranges), *order).withColumn("_part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_part").orderBy(*order)
    totals = placed.groupBy("_part").agg(F.sum(seconds).alias("_t"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    bases = totals.select("_part", F.coalesce(F.sum("_t").over(before), F.lit(0.0)).alias("_base"), (F.row_number().over(Window.orderBy("_part")) == 1).alias("_lead"))
    own = placed.withColumn("_own", F.coalesce(F.sum(seconds).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("_row", F.row_number().over(inside))
    out = own.join(bases, "_part")
    return out.where((F.col("_base") + F.col("_own") < target) | (F.col("_lead") & (F.col("_row") == 1))).select(*columns)


def seeded_subset(rows: DataFrame, n: int, seed: int = 42, key: str = "sample_id") -> DataFrame:
    """The first n rows in order of SHA-256 of seed and ID: the same for any order of input."""
    return rows.orderBy(seeded_order(seed, key), key).limit(n)


def stop_rule(evaluations: DataFrame, step: str = "step", metric: str = "wer", run: str | None = None) -> DataFrame:
    """Adds rising (the last three values rise strictly) and non_finite; training stops at either."""
    order = (Window.partitionBy(run) if run else Window.partitionBy()).orderBy(step)
    one, two = F.lag(metric, 1).over(order), F.lag(metric, 2).over(order)
    value = F.col(metric)
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return evaluations.withColumn("rising", F.coalesce((two < one) & (one < value), F.lit(False))).withColumn("non_finite", bad)


def should_stop(values: list[float]) -> bool:
    return len(values) >= 3 and values[-3] < values[-2] < values[-1]


def latest_checkpoint(directory: str | Path, needed: tuple[str, ...] = CHECKPOINT_FILES) -> Path | None:
    """The complete checkpoint-<step> of the highest step."""
    found = []
    for path in Path(directory).glob("checkpoint-*"):
        step = re.fullmatch(r"checkpoint-(\d+)", path.name)
        if step and path.is_dir() and all((path / name).is_file() for name in needed):
            found.append((int(step[1]), path))
    return max(found)[1] if found else None


def select_candidate(config: Mapping, run: str) -> dict:
    """A pilot run's configuration: rank and learning rate overridden."""
    by_run = {c["run"]: c for c in config.get("pilot_candidates") or []}
    if run not in by_run:
        raise ValueError(f"unknown pilot run: {run!r}")
    chosen = by_run[run]
    return {**config, "lora": {**config["lora"], "r": chosen["lora_rank"]}, "training": {**config["training"], "learning_rate": chosen["learning_rate"]}}


def missing_checkpoint_files(directory: str | Path, needed: tuple[str, ...] = CHECKPOINT_FILES) -> list[str]:
    return [name for name in needed if not (Path(directory) / name).is_file()]


def resume_from(output_dir: str | Path, explicit: str | Path | None = None, automatic: bool = False) -> Path | None:
    """The checkpoint to go on from: the one named, else (where wanted) the latest complete one, else none."""
    if explicit is None:
        return latest_checkpoint(output_dir) if automatic else None
    if lacking := missing_checkpoint_files(explicit):
        raise ValueError(f"checkpoint {explicit} is incomplete, it lacks {', '.join(lacking)}")
    return Path(explicit)


@dataclass(frozen=True)
class LoraSettings:
    """The adapter part of a configuration, checked when made."""

    rank: int
    alpha: int
    dropout: float
    modules: tuple[str, ...]

    def __post_init__(self) -> None:
        for name in ("rank", "alpha"):
            value = getattr(self, name)
            if type(value) is not int or value < 1:
                raise ValueError(f"lora: {name} must be a whole number above 0, not {value!r}")
        if type(self.dropout) not in (int, float) or not 0 <= self.dropout < 1:
            raise ValueError(f"lora: dropout must be a number from 0 to below 1, not {self.dropout!r}")
        if not self.modules or any(type(m) is not str for m in self.modules):
            raise ValueError("lora: target modules must be names, one at least")

    @classmethod
    def of(cls, section: Mapping) -> LoraSettings:
        modules = section.get("target_modules")
        return cls(section.get("r"), section.get("alpha"), section.get("dropout"), tuple(modules) if isinstance(modules, list) else ())

    def keywords(self) -> dict:
        """As the adapter library names them."""
        return {"r": self.rank, "lora_alpha": self.alpha, "lora_dropout": float(self.dropout), "target_modules": list(self.modules), "bias": "none", "task_type": "SEQ_2_SEQ_LM"}


def training_plan(config: Mapping, split_dir: str | Path, model_revision: str, dataset_revision: str) -> dict:
    """A checked plan: revisions are 40 hex digits and the split files are there."""
    for name, value in (("model", model_revision), ("dataset", dataset_revision)):
        if not re.fullmatch("[0-9a-f]{40}", value or ""):
            raise ValueError(f"{name} revision must be a full commit hash")
    files = {name: Path(split_dir) / name for name in ("train.jsonl", "validation.jsonl", "test.jsonl", "metadata.json")}
    if missing := [n for n, p in files.items() if not p.is_file()]:
        raise ValueError(f"split files are missing: {', '.join(missing)}")
    t, pilot = config["training"], config.get("pilot_subset")
    return {
        "experiment": config["experiment"]["name"], "model": config["model"]["id"], "model_revision": model_revision, "dataset_revision": dataset_revision,
        "effective_batch": t["per_device_train_batch_size"] * t["gradient_accumulation_steps"], "learning_rate": t["learning_rate"], "epochs": t["epochs"],
        "lora": LoraSettings.of(config["lora"]).keywords(), "seed": t["seed"], "files": {n: str(p) for n, p in files.items()},
        "dataset": (config.get("dataset") or {}).get("id"), "load_in_8bit": config["model"].get("load_in_8bit") is True, "fp16": t.get("fp16") is True,
        "training": dict(t), "augmentation": dict(config.get("augmentation") or {}), "split_dir": str(split_dir),
        "pilot_target_hours": float(pilot.get("target_hours", 5.0)) if pilot is not None else None,
        "pilot_validation_examples": int(pilot.get("validation_examples", 128)) if pilot is not None else None,
    }
