"""Mailbox archive and lifecycle engine on PySpark."""

from lettermill.operators.filters import UNSET, BoundFilter, MessageFilter
from lettermill.operators.folders import FolderChoice
from lettermill.plans.commands import (
    CallTarget,
    Count,
    Delete,
    Fetch,
    MaildirTarget,
    Mark,
    TableTarget,
    describe,
)
from lettermill.plans.pipeline import CatastrophicFailure, Mailbox, Result, fetch, run_pipeline
from lettermill.sources.store import Store
from lettermill.streaming.cycles import Callbacks, follow_arrivals, run_cycle, run_cycles

__all__ = [
    "UNSET",
    "BoundFilter",
    "CallTarget",
    "Callbacks",
    "CatastrophicFailure",
    "Count",
    "Delete",
    "Fetch",
    "FolderChoice",
    "Mailbox",
    "MaildirTarget",
    "Mark",
    "MessageFilter",
    "Result",
    "Store",
    "TableTarget",
    "describe",
    "fetch",
    "follow_arrivals",
    "run_cycle",
    "run_cycles",
    "run_pipeline",
]
