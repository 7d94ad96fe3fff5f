"""Contracts that the driver checks before a stage starts: gate reports, configurations, sample manifests."""

from __future__ import annotations

import json
from pathlib import Path

from ..functions.scalars import PENALTY_MAX
from ..sources.ingest import dotted
from .selection import seeded_indices

#: Values that a reproduction has to state.
GAMMA = 0.99


class ContractError(ValueError):
    """A stage's input is not what the stage before promised."""


def need(condition: bool, message: str) -> None:
    if not condition:
        raise ContractError(message)


def check_gate_report(report: dict, manifest: dict, data_sha256: str, seed: int, schema: str, least: int = 1) -> None:
    """The consistency gate has passed on this very data, with a sample that is unique and as large as told."""
    need(report.get("schema") == schema, "the gate report has another schema")
    need(report.get("gate_status") == "pass", "the gate has not passed")
    count = report.get("metrics", {}).get("sample_count")
    need(isinstance(count, int) and not isinstance(count, bool) and count >= least, "the gate report has no sample count")
    need(report.get("seed") == seed and manifest.get("seed") == seed, "the seeds differ")
    indices = manifest.get("indices")
    need(isinstance(indices, list) and len(indices) == len(set(indices)) == count == manifest.get("actual_sample_size"), "the sample is not what the report counts")
    need(manifest.get("data_sha256") == data_sha256, "the sample is of other data")


def sample_indices(path: str, data_sha256: str, total: int, size: int, seed: int = 42) -> list[int]:
    """Saved sample positions if they are of the same data, size and seed; else new ones, which are saved."""
    file = Path(path)
    asked = {"data_sha256": data_sha256, "requested_sample_size": size, "seed": seed, "total": total}
    if file.exists():
        saved = json.loads(file.read_text(encoding="utf-8"))
        if all(saved.get(k) == v for k, v in asked.items()):
            return saved["indices"]
    indices = sorted(seeded_indices(total, size, seed))
    made = json.dumps(asked | {"actual_sample_size": len(indices), "indices": indices}, indent=2) + "\n"
    part = file.with_name(file.name + ".part")
    part.write_text(made, encoding="utf-8")
    part.replace(file)
    return indices


def check_configuration(config: dict, required: tuple[str, ...], revisions: tuple[str, ...] = ()) -> None:
    """All required keys are there, gamma and the largest penalty are the published ones, revisions are full."""
    for key in required:
        need(dotted(config, key, None) is not None, f"{key} is missing")
    if "ppo.gamma" in required:
        need(dotted(config, "ppo.gamma") == GAMMA, "gamma is not the published one")
    if "reward.p_max" in required:
        need(dotted(config, "reward.p_max") == PENALTY_MAX, "the largest penalty is not the published one")
    for key in revisions:
        value = dotted(config, key)
        need(isinstance(value, str) and len(value) == 40 and set(value) <= set("0123456789abcdef"), f"{key} is no full revision")


def check_training_arguments(steps: int, batch: int, mini_batch: int, epochs: int) -> None:
    for name, value in (("steps", steps), ("batch", batch), ("mini_batch", mini_batch), ("epochs", epochs)):
        need(isinstance(value, int) and not isinstance(value, bool) and value > 0, f"{name} must be a positive integer")
    need(batch % mini_batch == 0, "a batch must hold whole mini-batches")
