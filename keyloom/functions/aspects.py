"""Hooks: value transforms, vetoes and notifications. Compose by inheritance; one object serves a database."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class Aspect:
    """Columns for per-row hooks, plain methods for per-operation hooks. A `before_` or `may_` hook vetoes by false."""

    def on_write(self, key: Column, value: Column) -> Column:
        return value

    def on_read(self, key: Column, value: Column) -> Column:
        return value

    def may_delete(self, key: Column, value: Column) -> Column:
        return F.lit(True)

    def before_find(self, key: Column) -> Column:
        """Probes for which this is false find nothing."""
        return F.lit(True)

    def on_find(self, probes: int, hits: int) -> None: ...

    def on_next(self, steps: int, hits: int) -> None:
        """Steps towards greater keys, and how many of them reached a record."""
        self.on_navigate(steps)

    def on_prev(self, steps: int, hits: int) -> None:
        """Steps towards smaller keys."""
        self.on_navigate(steps)

    def on_navigate(self, steps: int) -> None: ...

    def big_meta(self, key: Column, value: Column) -> Column:
        return F.lit(None).cast("binary")

    def before_start_transaction(self) -> bool:
        return True

    def on_start_transaction(self, txn_id: int) -> None: ...

    def before_commit(self, txn_id: int) -> bool:
        return True

    def on_commit(self, txn_id: int, origin: str) -> None: ...

    def before_rollback(self, txn_id: int) -> bool:
        return True

    def on_rollback(self, txn_id: int) -> None: ...

    def on_sanitize(self) -> None: ...

    def before_defrag(self) -> bool:
        return True

    def on_defrag(self) -> None: ...

    def before_reset(self) -> bool:
        return True

    def on_reset(self) -> None: ...

    def may_merge_overwrite(self, key: Column, old: Column, new: Column) -> Column:
        return F.lit(True)

    def may_merge_add(self, key: Column, new: Column) -> Column:
        return F.lit(True)

    def may_merge_delete(self, key: Column, meta: Column) -> Column:
        return F.lit(True)


class Metrics(Aspect):
    """Counters over what a database did; mix in before other aspects."""

    def __init__(self) -> None:
        self.counts = dict.fromkeys(
            ("writes", "bytes_written", "reads", "bytes_read", "deletes", "user_started", "user_committed", "user_rolled_back", "merge_committed", "defrag_committed", "finds", "finds_hit", "navigations", "sanitize", "defrag", "reset", "overwrites", "adds", "merge_deletes"), 0
        )

    def add(self, **more: int | None) -> None:
        for k, n in more.items():
            self.counts[k] += n or 0

    def on_start_transaction(self, txn_id: int) -> None:
        self.add(user_started=1)
        super().on_start_transaction(txn_id)

    def on_commit(self, txn_id: int, origin: str) -> None:
        self.add(**{f"{origin}_committed": 1})
        super().on_commit(txn_id, origin)

    def on_rollback(self, txn_id: int) -> None:
        self.add(user_rolled_back=1)
        super().on_rollback(txn_id)

    def on_find(self, probes: int, hits: int) -> None:
        self.add(finds=probes, finds_hit=hits)
        super().on_find(probes, hits)

    def on_navigate(self, steps: int) -> None:
        self.add(navigations=steps)
        super().on_navigate(steps)

    def on_sanitize(self) -> None:
        self.add(sanitize=1)
        super().on_sanitize()

    def on_defrag(self) -> None:
        self.add(defrag=1)
        super().on_defrag()

    def on_reset(self) -> None:
        self.add(reset=1)
        super().on_reset()

    def _some(self, *names: str) -> dict[str, int]:
        return {n: self.counts[n] for n in names}

    def ops_snapshot(self) -> dict[str, int]:
        return self._some("writes", "bytes_written", "reads", "bytes_read", "deletes")

    def txn_snapshot(self) -> dict[str, int]:
        return self._some("user_started", "user_committed", "user_rolled_back", "merge_committed", "defrag_committed")

    def nav_snapshot(self) -> dict[str, int]:
        return self._some("finds", "finds_hit", "navigations")

    def maintenance_snapshot(self) -> dict[str, int]:
        return self._some("sanitize", "defrag", "reset")

    def merge_snapshot(self) -> dict[str, int]:
        return self._some("overwrites", "adds", "merge_deletes")
