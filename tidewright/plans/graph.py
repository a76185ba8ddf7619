"""Stages, workflows, and their validation."""

from __future__ import annotations

import re
import weakref
from collections.abc import Callable, Iterable
from copy import deepcopy
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from ..errors import WorkflowError
from ..functions.codec import encode_ordered
from ..functions.pointer import parts

NAME = re.compile(r"[a-z][a-z0-9]*(?:[-_][a-z0-9]+)*\Z")


@dataclass(frozen=True, eq=False)
class Stage:
    """A declared step.  Equality is identity: only stages made by :func:`stage` bind.

    depends maps binding names to stages; run(ctx) returns a JSON value or a
    DataFrame.  A stage is reusable when it names a ``revision`` of its code;
    then its inputs, environment names, watched files and dependencies' outputs
    are its influences.  ``selectors`` narrow the inputs to JSON pointers, with a
    contract each where they are given as a mapping.  A ``volatile`` stage says
    that its result may differ between runs; it can't name a revision.  ``order``
    gives a total key of a DataFrame output whose row order matters.
    """

    id: str
    run: Callable[[Any], Any]
    depends: dict[str, Stage] = field(default_factory=dict)
    inputs: dict[str, Any] = field(default_factory=dict)
    env: tuple[str, ...] = ()
    watch: tuple[str, ...] = ()
    revision: str | None = None
    selectors: tuple[str, ...] | None = None
    contracts: dict[str, str] = field(default_factory=dict)
    volatile: bool = False
    order: tuple[str, ...] = ()

    @property
    def policy(self) -> str:
        return "reusable" if self.revision is not None else "always-execute"


_MADE: weakref.WeakSet[Stage] = weakref.WeakSet()


def stage(id: str, run: Callable[[Any], Any] | None = None, **declared: Any):
    """Declares a stage; without ``run`` it is a decorator."""
    if run is None:
        return lambda f: stage(id, f, **declared)
    if not isinstance(id, str) or not NAME.match(id):
        raise WorkflowError("invalid_stage_id", "stage", stage=id)
    if not callable(run):
        raise WorkflowError("invalid_callback", "stage", stage=id)
    if isinstance(declared.get("selectors"), dict):
        declared["contracts"] = {**declared["selectors"], **(declared.get("contracts") or {})}
    for key in ("env", "watch", "selectors", "order"):
        if declared.get(key) is not None:
            declared[key] = tuple(declared[key])
    declared["inputs"] = deepcopy(declared.get("inputs") or {})
    declared["depends"] = dict(declared.get("depends") or {})
    made = Stage(id=id, run=run, **declared)
    _MADE.add(made)
    return made


def id_of(s: Stage) -> int:
    return id(s)


def _issues(stages: list[Stage], watched: bool) -> list[tuple[str, str]]:
    found, seen = [], set()
    known = {id_of(s) for s in stages}
    for s in stages:
        if not isinstance(s, Stage) or s not in _MADE:
            found.append(("invalid_stage", getattr(s, "id", repr(s))))
            continue
        if s.id in seen:
            found.append(("duplicate_stage", s.id))
        seen.add(s.id)
        try:
            if not isinstance(s.inputs, dict):
                raise WorkflowError("invalid_value", "encode")
            encode_ordered(s.inputs)
        except WorkflowError:
            found.append(("invalid_inputs", s.id))
        for name, target in s.depends.items():
            if not isinstance(name, str) or not name:
                found.append(("invalid_binding", s.id))
            if target is s:
                found.append(("self_dependency", s.id))
            elif id_of(target) not in known:
                found.append(("missing_dependency", f"{s.id}.{name}"))
        for names, code in ((s.env, "duplicate_env"), (s.watch, "duplicate_watch"), (s.selectors or (), "duplicate_input")):
            if len(set(names)) != len(names):
                found.append((code, s.id))
        if any(not isinstance(e, str) or not e or "=" in e or "\0" in e for e in s.env):
            found.append(("invalid_env", s.id))
        if any(not isinstance(w, str) or not w or "\0" in w for w in s.watch):
            found.append(("invalid_watch", s.id))
        for pointer in s.selectors or ():
            try:
                parts(pointer)
            except (WorkflowError, AttributeError):
                found.append(("invalid_input_pointer", f"{s.id} {pointer}"))
        for pointer, contract in s.contracts.items():
            if pointer not in (s.selectors or ()) or not isinstance(contract, str) or not contract.strip():
                found.append(("invalid_input_contract", f"{s.id} {pointer}"))
        if not isinstance(s.volatile, bool) or (s.volatile and s.revision is not None):
            found.append(("invalid_cache_policy", s.id))
        if watched and s.revision is not None and not s.watch:
            found.append(("missing_watch", s.id))
        if s.revision is not None and not isinstance(s.revision, str):
            found.append(("invalid_revision", s.id))
        elif s.revision is not None and not s.revision.strip():
            found.append(("empty_implementation", s.id))
    left = [s for s in stages if isinstance(s, Stage) and s in _MADE]
    while ready := {id_of(s) for s in left if not {id_of(t) for t in s.depends.values()} & {id_of(t) for t in left}}:
        left = [s for s in left if id_of(s) not in ready]
    if left:
        found.append(("cycle", " -> ".join(cycle_path(left))))
    return found


def topological(stages: list[Stage], by: Callable[[Stage], Any] | None = None) -> list[Stage]:
    """Kahn's order; of ready stages the one declared first goes first, or the least by ``by``."""
    place = {id_of(s): (by(s) if by else i) for i, s in enumerate(stages)}
    waiting = {id_of(s): {id_of(t) for t in s.depends.values()} for s in stages}
    out, left = [], list(stages)
    while left:
        ready = [s for s in left if not waiting[id_of(s)]]
        if not ready:
            raise WorkflowError("cycle", "workflow", path=" -> ".join(cycle_path(left)))
        nxt = min(ready, key=lambda s: place[id_of(s)])
        out.append(nxt)
        left.remove(nxt)
        for s in left:
            waiting[id_of(s)].discard(id_of(nxt))
    return out


def cycle_path(stages: list[Stage]) -> list[str]:
    """One cycle, found by walking from the stage declared first, dependencies in order."""
    inside = {id_of(s) for s in stages}
    for start in stages:
        path, s = [], start
        while s is not None and s not in path:
            path.append(s)
            s = next((t for t in s.depends.values() if id_of(t) in inside), None)
        if s is not None:
            return [x.id for x in path[path.index(s) :]] + [s.id]
    return []


class Workflow:
    """A validated graph; stages are in topological order.

    With ``require_watch`` every reusable stage must watch a file, as the older planner asks.
    """

    def __init__(self, id: str, stages: Iterable[Stage], root: str | Path = ".", require_watch: bool = False):
        stages = list(stages)
        if not isinstance(id, str) or not NAME.match(id):
            raise WorkflowError("invalid_workflow_id", "workflow", workflow=id)
        if not stages:
            raise WorkflowError("empty_workflow", "workflow", workflow=id)
        self.id, self.root = id, Path(root).resolve()
        if issues := _issues(stages, require_watch):
            raise WorkflowError(issues[0][0], "workflow", f"{len(issues)} issues", issues=issues)
        self.stages = topological(stages)
        self.by_id = {s.id: s for s in self.stages}
        self.needs = {s.id: sorted({t.id for t in s.depends.values()}) for s in self.stages}

    def add(self, *stages: Stage) -> None:
        """A workflow is sealed once it is made; a changed graph is another workflow."""
        raise WorkflowError("sealed_workflow", "workflow", workflow=self.id, stages=[getattr(s, "id", repr(s)) for s in stages])

    def upstream(self, id: str) -> set[str]:
        out: set[str] = set()
        todo = list(self.needs[id])
        while todo:
            if (x := todo.pop()) not in out:
                out.add(x)
                todo += self.needs[x]
        return out

    def downstream(self, ids: Iterable[str]) -> set[str]:
        """The given stages and everything that depends on them."""
        wanted = set(ids)
        for s in self.stages:
            if wanted & set(self.needs[s.id]):
                wanted.add(s.id)
        return wanted

    def layers(self) -> dict[str, int]:
        depth: dict[str, int] = {}
        for s in self.stages:
            depth[s.id] = 1 + max((depth[n] for n in self.needs[s.id]), default=-1)
        return depth

    def edges(self, spark):
        """(workflow, src, dst, binding) as a DataFrame."""
        rows = [(self.id, t.id, s.id, name) for s in self.stages for name, t in s.depends.items()]
        return spark.createDataFrame(rows, "workflow string, src string, dst string, binding string")
