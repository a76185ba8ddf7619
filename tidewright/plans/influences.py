"""What a stage's output depends on, as digests of six components."""

from __future__ import annotations

import hashlib
import os
from pathlib import Path
from typing import Any

from ..errors import WorkflowError
from ..functions.codec import encode_ordered
from ..functions.identity import digest
from ..functions.pointer import select_inputs
from .graph import Stage

COMPONENTS = ("contract", "inputs", "dependencies", "environment", "implementation", "watchedFiles")
CONTRACT = "tidewright/declared-influences/v1"


def _inside(path: Path, folder: Path) -> bool:
    return path == folder or folder in path.parents


def observe_files(names: tuple[str, ...], root: Path, history: Path | None, absolute: bool = False, missing_is_value: bool = False) -> list[dict[str, Any]]:
    """Digest of each watched file, sorted; exact regular files only.

    Relative names stay under the root after links are followed; no file may lie
    in, or be a hard link to a file of, the history.  Two names of one physical
    file are an error.  Files are named relative to the root unless ``absolute``.
    A missing file is an error, or with ``missing_is_value`` an observation of its
    own ({path, state: missing}) if the folder it is missing from lies under the root.
    """
    seen: dict[tuple[int, int], str] = {}
    out = []
    for name in names:
        given = Path(name)
        if missing_is_value and not os.path.lexists(place := given if given.is_absolute() else root / given):
            held = next(p for p in place.parents if p.exists()).resolve()
            if not given.is_absolute() and not _inside(held, root):
                raise WorkflowError("watched_file_outside_root", "observe", file=name)
            out.append({"path": name, "state": "missing"})
            continue
        try:
            real = (given if given.is_absolute() else root / given).resolve(strict=True)
        except (OSError, ValueError) as e:
            raise WorkflowError("watched_file_unreadable", "observe", file=name) from e
        if not given.is_absolute() and not _inside(real, root):
            raise WorkflowError("watched_file_outside_root", "observe", file=name)
        if not real.is_file():
            raise WorkflowError("watched_file_not_regular", "observe", file=name)
        if history is not None and _inside(real, history):
            raise WorkflowError("watched_file_in_history", "observe", file=name)
        stat = real.stat()
        key = (stat.st_dev, stat.st_ino)
        if stat.st_nlink > 1 and history is not None and history.exists() and any((s := p.stat()).st_ino == stat.st_ino and s.st_dev == stat.st_dev for p in history.rglob("*") if p.is_file()):
            raise WorkflowError("watched_file_in_history", "observe", file=name)
        if key in seen:
            raise WorkflowError("duplicate_watched_file", "observe", file=name, other=seen[key])
        seen[key] = name
        h = hashlib.sha256(b"tidewright/watched-file/v1\0")
        with real.open("rb") as f:
            while piece := f.read(1 << 20):
                h.update(piece)
        shown = str(real) if absolute or not _inside(real, root) else real.relative_to(root).as_posix()
        out.append({"path": shown, "hash": "sha256:" + h.hexdigest()})
    return sorted(out, key=lambda f: f["path"])


def observe_environment(names: tuple[str, ...], env: dict[str, str]) -> dict[str, Any]:
    """Presence told apart from emptiness; values only as digests."""
    return {n: digest("tidewright/environment-value/v1", env[n].encode("utf-8", "surrogateescape")) if n in env else None for n in sorted(names)}


def table_snapshot(path: str | Path, strict: bool = True) -> list[dict[str, Any]]:
    """Identity of a folder of data files: path, length and digest of each; lengths and times alone if not strict."""
    base = Path(path)
    out = []
    for p in sorted(x for x in base.rglob("*") if x.is_file() and not x.name.startswith((".", "_"))):
        s = p.stat()
        own = {"path": p.relative_to(base).as_posix(), "length": s.st_size}
        if strict:
            with p.open("rb") as f:
                own["hash"] = "sha256:" + hashlib.file_digest(f, "sha256").hexdigest()
        else:
            own["modified"] = int(s.st_mtime)
        out.append(own)
    return out


def components(stage: Stage, inputs: dict[str, Any], env: dict[str, str], outputs: dict[str, str | None], root: Path, history: Path | None, absolute: bool = False) -> dict[str, str]:
    """Digests by component.  outputs: hash of each dependency's output by stage id; None while unknown."""
    bindings = [{"name": name, "stageId": t.id, "hash": outputs.get(t.id)} for name, t in sorted(stage.depends.items())]
    own = inputs if stage.selectors is None else select_inputs(inputs, {p: stage.contracts.get(p, "required-json-v1") for p in stage.selectors})
    bodies = {
        "contract": {"contract": CONTRACT, "order": list(stage.order)},
        "inputs": own,
        "dependencies": bindings,
        "environment": observe_environment(stage.env, env),
        "implementation": stage.revision,
        "watchedFiles": observe_files(stage.watch, root, history, absolute),
    }
    return {k: digest(f"tidewright/component/{k}/v1", encode_ordered(bodies[k]).encode()) for k in COMPONENTS}


def fingerprint(workflow: str, stage: str, parts: dict[str, str]) -> str:
    return digest("tidewright/fingerprint/v1", encode_ordered({"workflowId": workflow, "stageId": stage, "components": parts}).encode())


def environment() -> dict[str, str]:
    return dict(os.environ)
