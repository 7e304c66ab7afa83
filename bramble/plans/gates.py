"""Feature gates: operators, exchanges and statements that an installation restricts, and runtime features."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from ..diagnostics import Code, fail

#: What can be restricted.
RESTRICTED = (
    "relation_buffer",
    "relation_identify",
    "relation_join_find",
    "relation_join_scan",
    "relation_semi_join",
    "relation_anti_join",
    "relation_write_insert",
    "relation_values",
    "relation_difference",
    "relation_flatten",
    "relation_intersection",
    "relation_apply",
    "exchange_aggregate",
    "exchange_broadcast",
    "exchange_discard",
    "exchange_forward",
    "exchange_group",
    "statement_write_delete",
    "statement_write_update",
    "statement_truncate_table",
    "statement_truncate_table_restart_identity",
)

#: What a runtime may be able to do.
RUNTIME = ("broadcast_exchange", "aggregate_exchange", "index_join", "index_join_scan", "broadcast_join_scan", "always_inline_scalar_local_variables")
DEFAULT_RUNTIME = frozenset(RUNTIME[:-1])


@dataclass(frozen=True)
class Options:
    """How a session plans.

    disjunction_range_hint: filters by a disjunction get the ranges that follow from it.
    inline_host_variables: variables are literals of the plan, which Catalyst folds; otherwise they are read when it runs.
    """

    disjunction_range_hint: bool = True
    inline_host_variables: bool = True


class Gates:
    """Restricted features raise unsupported_feature when something uses them."""

    def __init__(self, restricted: Iterable[str] = (), runtime: Iterable[str] = DEFAULT_RUNTIME):
        self.restricted, self.runtime = frozenset(restricted), frozenset(runtime)
        if unknown := (self.restricted - set(RESTRICTED)) | (self.runtime - set(RUNTIME)):
            raise ValueError(f"there are no features {sorted(unknown)}")

    def check(self, feature: str) -> None:
        if feature in self.restricted:
            raise fail(Code.UNSUPPORTED_FEATURE, f"{feature} is unsupported")

    def spark_conf(self) -> dict[str, str]:
        """Spark's settings that have the same effect as the runtime features' absence."""
        return {} if "broadcast_exchange" in self.runtime else {"spark.sql.autoBroadcastJoinThreshold": "-1"}
