"""One error class; its codes are part of the interface."""

from __future__ import annotations

from typing import Any


class WorkflowError(Exception):
    """code is stable, operation says what was being done, context is structured."""

    def __init__(self, code: str, operation: str, message: str = "", **context: Any):
        self.code, self.operation, self.context = code, operation, context
        detail = ", ".join(f"{k}={v!r}" for k, v in context.items())
        super().__init__(f"{operation}: {message or code}" + (f" ({detail})" if detail else ""))
