"""Incremental, explainable dataflow on Spark."""

from .engine import prepare
from .errors import WorkflowError
from .history import History
from .plans.graph import Workflow, stage

__all__ = ["History", "Workflow", "WorkflowError", "prepare", "stage"]
