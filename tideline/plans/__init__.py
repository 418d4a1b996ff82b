"""Distributed building blocks shared by the operators."""

from tideline.plans.attach import attach
from tideline.plans.ordered import LastSeen, NextSeen, Running, Swept, framed, overlap, scan, with_position
from tideline.plans.quantiles import quantiles
from tideline.plans.scratch import freeze, rows_of, scratch_path, scratch_root, scratch_scope
from tideline.plans.smallest import smallest

__all__ = [
    "LastSeen",
    "NextSeen",
    "Running",
    "Swept",
    "attach",
    "framed",
    "freeze",
    "overlap",
    "quantiles",
    "rows_of",
    "scan",
    "scratch_path",
    "scratch_root",
    "scratch_scope",
    "smallest",
    "with_position",
]
