"""Exact validation of configuration mappings."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any


def integer(lo: int, hi: int | None = None):
    def check(v: Any) -> bool:
        return isinstance(v, int) and not isinstance(v, bool) and v >= lo and (hi is None or v <= hi)

    return check


def number(lo: float, hi: float, open_ends: bool = True):
    def check(v: Any) -> bool:
        return isinstance(v, (int, float)) and not isinstance(v, bool) and (lo < v < hi if open_ends else lo <= v <= hi)

    return check


def text(v: Any) -> bool:
    return isinstance(v, str) and bool(v)


def iso(v: Any) -> bool:
    from massflow.operators.splits import iso_date

    try:
        iso_date(v)
    except (ValueError, TypeError):
        return False
    return True


def symbols(v: Any) -> bool:
    return isinstance(v, list) and len(v) > 0 and all(map(text, v)) and len(set(v)) == len(v)


def integers(lo: int):
    return lambda v: isinstance(v, list) and bool(v) and all(integer(lo)(x) for x in v) and len(set(v)) == len(v)


def validate(config: Mapping[str, Any], schema: Mapping[str, Any]) -> dict[str, Any]:
    """The config, if its keys are exactly those of the schema and every value
    passes; a bool is no number."""
    if not isinstance(config, Mapping) or set(config) != set(schema):
        raise ValueError(f"keys must be exactly {sorted(schema)}")
    bad = [k for k, ok in schema.items() if not ok(config[k])]
    if bad:
        raise ValueError(f"values that are not valid: {', '.join(sorted(bad))}")
    return dict(config)


def hexadecimal(v: Any) -> bool:
    return isinstance(v, str) and re.fullmatch("[0-9a-f]{64}", v) is not None


def assets(least: int = 1):
    """Snapshots: symbol, dataset and hash of each, symbols unique."""
    def check(v: Any) -> bool:
        good = isinstance(v, list) and len(v) >= least and all(isinstance(a, Mapping) and set(a) == {"symbol", "dataset", "sha256"} and text(a["symbol"]) and text(a["dataset"]) and hexadecimal(a["sha256"]) for a in v)
        return good and symbols([a["symbol"] for a in v])

    return check


def one_of(*names: str):
    return lambda v: isinstance(v, str) and v in names


def numbers(lo: float, hi: float):
    """A list of different numbers in (lo, hi]."""
    ok = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and lo < v <= hi
    return lambda v: isinstance(v, list) and bool(v) and all(map(ok, v)) and len(set(v)) == len(v)


def dates(v: Any) -> bool:
    """A list of increasing dates."""
    return isinstance(v, list) and bool(v) and all(map(iso, v)) and all(a < b for a, b in zip(v, v[1:], strict=False))


def ordered(config: Mapping[str, Any], *keys: str) -> None:
    if not all(config[a] < config[b] for a, b in zip(keys, keys[1:], strict=False)):
        raise ValueError(f"dates must increase: {', '.join(keys)}")


def moment(v: Any) -> bool:
    from massflow.operators.splits import moment as parse

    try:
        parse(v)
    except (ValueError, TypeError):
        return False
    return True


CALENDAR = one_of("new_york", "daily", "weekly")
VERSION = lambda v: v == 1 and not isinstance(v, bool)
RISK = {"window": integer(2), "horizon": integer(1), "min_history": integer(1), "prior": number(0, 1e9, False), "decay": number(0, 1), "training_end": integer(0), "blocks": integers(1), "reps": integer(1), "seed": integer(0)}

#: A study of a joint panel of snapshots.
JOINT = {
    "version": VERSION, "assets": assets(2), "provider": text, "price_column": text, "calendar": CALENDAR, "train_end": iso, "validation_end": iso, "assessment_end": iso, "length": integer(2), "fit_stride": integer(1),
    "ks": integers(2), "seed": integer(0), "projections": integer(1), "candidates": integer(2, 1024), "n_init": integer(1), "selection_sample": integer(2, 1000), "baseline_n_init": integer(1), "hmm_n_init": integer(1), "hmm_max_iter": integer(1),
    "projection_counts": integers(1), "projection_seeds": integers(0), "bootstrap_repeats": integer(1), "bootstrap_block_windows": integer(1), "exposure": one_of("exploratory"),
}
#: Robustness of a joint study's model.
VALIDATION = {
    "version": VERSION, "market_config": text, "block_lengths": integers(1), "bootstrap_repeats": integer(1), "chronological_ends": dates, "candidate_sizes": integers(2), "optimizer_seeds": integers(0),
    "synthetic_seeds": integers(0), "outlier_fractions": numbers(0, 1), "outlier_magnitude": number(0, 1e9), "seed": integer(0),
}
#: A study of one asset, year by year.
RUN = {
    "version": VERSION, "symbol": text, "dataset": text, "sha256": hexadecimal, "provider": text, "price_column": text, "calendar": CALENDAR, "length": integer(2), "fit_stride": integer(1), "score_stride": integer(1), "fit_strides": integers(1), "horizon": integer(1),
    "ks": integers(2), "seed": integer(0), "n_init": integer(1), "models": symbols, "years": integers(1900), "holdout_start": iso, "data_cutoff": iso, "validation_years": integer(1), "novelty": number(0, 1),
    "seed_repeats": integer(1), "bootstrap_repeats": integer(1), "bootstrap_block": integer(1), "null_repeats": integer(1),
}
#: What a frozen bundle promises; exactly these.
CONTRACT = {
    "version": VERSION, "symbols": symbols, "length": integer(2), "provider": text, "price_column": text, "return_basis": one_of("adjusted_close"), "calendar": CALENDAR, "train_end": iso, "calibration_end": iso,
    "novelty_threshold": number(0, 1e300, False), "model": one_of("scaled_joint", "raw_joint"), "parent": hexadecimal, "numerical_sources": lambda v: isinstance(v, Mapping) and bool(v), "dependencies": lambda v: isinstance(v, Mapping) and bool(v),
}
SCORE = {"version": VERSION, "assets": assets(2), "provider": text, "price_column": text, "start": iso, "end": iso, "as_of": moment}


def same_protocol(configs: Mapping[str, Mapping[str, Any]]) -> None:
    """Configurations of several assets may differ in what names the asset only."""
    if not configs:
        raise ValueError("there are no configurations")
    free = {"symbol", "dataset", "sha256"}
    common = [{k: v for k, v in c.items() if k not in free} for c in configs.values()]
    for name, c in zip(configs, common, strict=True):
        if c != common[0]:
            raise ValueError(f"the protocol of {name} differs: {', '.join(sorted(k for k in c.keys() | common[0].keys() if c.get(k) != common[0].get(k)))}")
