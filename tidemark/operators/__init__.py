"""Operators: scans and key ranges, the ledger, copying and its orchestration, reports and comparison."""

from .ledger import Ledger
from .reconcile import reconcile
from .reports import batch_report, chunk_report, summary
from .scan import key_range, row_count, usable_key
from .sync import SyncEngine
from .verify import verify

__all__ = ["Ledger", "SyncEngine", "batch_report", "chunk_report", "key_range", "reconcile", "row_count", "summary", "usable_key", "verify"]
