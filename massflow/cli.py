"""Command line: ``python -m massflow.cli run --config CONFIG.json`` and others.

Configurations are JSON files; ``massflow.plans.config`` has their schemas."""

from __future__ import annotations

import argparse
import json
from pathlib import Path
from typing import Any


def _read(path: str) -> Any:
    return json.loads(Path(path).read_text())


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="massflow")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, text: str, *required: str, stages: tuple[str, ...] = (), root: str | None = None, **more: tuple[type, Any]) -> None:
        q = sub.add_parser(name, help=text)
        for a in required:
            q.add_argument(f"--{a}", required=True)
        if stages:
            q.add_argument("--stage", choices=stages, default=stages[0])
        if root:
            q.add_argument("--output-root", default=root)
        for a, (kind, default) in more.items():
            q.add_argument(f"--{a.replace('_', '-')}", type=kind, default=default)

    add("run", "study one asset year by year", "config", stages=("development", "holdout"), root="artifacts", synthetic=(str, None))
    add("report", "write the page of a finished run again", "run")
    add("synthetic", "recovery of known laws by all methods", "config", output=(str, "artifacts/synthetic.json"))
    add("cross-asset", "the same study of several assets", "config", stages=("development", "holdout", "all"), root="artifacts")
    add("joint-study", "develop or assess a joint panel", "config", stages=("development", "assessment"), root="artifacts", development=(str, None))
    add("joint-validate", "robustness of a development", "config", "development", root="artifacts")
    add("freeze-joint", "export a verified model", "development", root="artifacts/bundles", model=(str, "scaled_joint"))
    add("score-joint", "score snapshots by a frozen contract", "bundle", "config", root="artifacts/jobs", threads=(int, 1), timeout=(float, 3600.0))
    add("run-jobs", "run or resume jobs", "config", root="artifacts/jobs", workers=(int, 2), threads=(int, 1), timeout=(float, 3600.0))
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    from massflow.plans import artifacts, frozen, joint, jobs, reports, synthetic_suite, univariate, validation
    from massflow.sources import files

    if a.command == "report":
        artifacts.verify(a.run)
        print(reports.run(a.run))
        return 0
    if a.command == "freeze-joint":
        print(frozen.freeze(a.development, a.output_root, a.model))
        return 0
    if a.command in ("score-joint", "run-jobs"):
        todo = _read(a.config) if a.command == "run-jobs" else [{"name": "score", "type": "score", "bundle": a.bundle, "config": a.config}]
        done = jobs.run(todo, a.output_root, getattr(a, "workers", 1), a.threads, a.timeout)
        print(json.dumps(done))
        return int(not done["success"])
    from massflow.session import build

    spark, cfg = build(), _read(a.config)
    if a.command == "run":
        out = univariate.run(spark, cfg, a.output_root, a.stage, _read(a.synthetic) if a.synthetic else None)
    elif a.command == "synthetic":
        out = Path(a.output)
        out.parent.mkdir(parents=True, exist_ok=True)
        files.write_json(out, synthetic_suite.run(spark, cfg))
    elif a.command == "cross-asset":
        out = univariate.cross_asset(spark, {s: _read(path) for s, path in cfg["assets"].items()}, a.output_root, a.stage)
    elif a.command == "joint-study":
        if a.stage == "assessment" and not a.development:
            raise SystemExit("an assessment needs --development")
        out = joint.develop(spark, cfg, a.output_root) if a.stage == "development" else joint.assess(spark, cfg, a.development)
    else:
        out = validation.run(spark, cfg, _read(cfg["market_config"]), a.development, a.output_root)
    print(out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
