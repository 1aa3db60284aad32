"""Layered options: system file, user file, file named by the environment, then flags; later layers win leaf by leaf."""

from __future__ import annotations

import argparse
import dataclasses
import os
from collections.abc import Mapping

from stratalign.plans.session import Params

ENV_FILE = "STRATALIGN_CONFIG"
LAYERS = ("/etc/stratalign/config.yaml", "~/.config/stratalign/config.yaml")


def deep_merge(base: Mapping, over: Mapping) -> dict:
    out = dict(base)
    for key, value in over.items():
        out[key] = deep_merge(out[key], value) if isinstance(value, Mapping) and isinstance(out.get(key), Mapping) else value
    return out


def load(extra: str | None = None) -> dict:
    import yaml

    merged: dict = {}
    for path in (*LAYERS, os.environ.get(ENV_FILE), extra):
        if path and os.path.exists(os.path.expanduser(path)):
            with open(os.path.expanduser(path), encoding="utf-8") as file:
                merged = deep_merge(merged, yaml.safe_load(file) or {})
    return merged


def parser() -> argparse.ArgumentParser:
    """Each option also has an environment variable STRATALIGN_<NAME>."""
    out = argparse.ArgumentParser("stratalign", description="Quality control of sequencing alignments")
    out.add_argument("inputs", nargs="+")
    out.add_argument("--gtf", required=True)
    out.add_argument("--outdir", default=os.environ.get("STRATALIGN_OUTDIR", "."))
    out.add_argument("--config", default=None)
    out.add_argument("--flat-output", action="store_true")
    out.add_argument("--json-summary", nargs="?", const="-", default=None)
    out.add_argument("--skip", action="append", default=[], help="an analysis to leave out")
    for f in dataclasses.fields(Params):
        name, env = f"--{f.name.replace('_', '-')}", os.environ.get(f"STRATALIGN_{f.name.upper()}")
        if f.type == "bool":
            out.add_argument(name, action="store_true", default=env == "1" if env else None)
        elif not f.type.startswith("dict"):
            out.add_argument(name, type={"int": int, "float": float}.get(f.type, str), default=env)
    return out


def params(args: argparse.Namespace) -> Params:
    known = {f.name for f in dataclasses.fields(Params)}
    layered = {k: v for k, v in load(args.config).items() if k in known}
    given = {k: v for k, v in vars(args).items() if k in known and v is not None}
    return Params(**deep_merge(layered, given))
