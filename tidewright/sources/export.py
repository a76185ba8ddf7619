"""Writing a value out of the history, for stages whose purpose is the side effect.

Such a stage names no revision, so it runs each time and is never reused.  It
writes only when asked to, and only below a folder that lies under the root.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from pathlib import Path
from typing import Any

from ..errors import WorkflowError
from ..functions.codec import encode_ordered


def contained_folder(root: str | Path, folder: str | Path) -> Path:
    """A folder that exists, is no link anywhere below the root, and lies under the root."""
    base = Path(root).resolve()
    given = Path(folder)
    at = given if given.is_absolute() else base / given
    if not at.is_dir() or at.resolve() != Path(os.path.normpath(at)) or not (at.resolve() == base or base in at.resolve().parents):
        raise WorkflowError("destination_not_contained", "export", path=str(folder))
    return at.resolve()


def export_value(root: str | Path, folder: str | Path, name: str, value: Any, enabled: bool = False) -> dict[str, Any]:
    """Writes ``name`` below the folder and tells its digest; without ``enabled`` nothing is touched."""
    if not enabled:
        return {"mode": "disabled", "filename": name}
    if Path(name).name != name or name in ("", ".", ".."):
        raise WorkflowError("destination_not_contained", "export", path=name)
    place = contained_folder(root, folder) / name
    if place.is_symlink() or (place.exists() and (not place.is_file() or place.stat().st_nlink > 1)):
        raise WorkflowError("destination_not_regular", "export", path=str(place))
    encode_ordered(value)
    data = (json.dumps(value, indent=2, ensure_ascii=False) + "\n").encode("utf-8", "surrogatepass")
    aside = place.with_name(f".{name}-{uuid.uuid4().hex}")
    aside.write_bytes(data)
    os.replace(aside, place)
    return {"mode": "published", "filename": name, "directory": str(place.parent), "sha256": "sha256:" + hashlib.sha256(data).hexdigest()}
