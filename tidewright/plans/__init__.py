"""Graphs of stages and the decision which of them run."""
