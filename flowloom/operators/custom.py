"""Flow features that a user declares: a value a packet, how values add up, and an expression of the result.

The values go with the packets through whole keys, chunks of hot keys and live batches, and what is kept for each flow
can be merged, so a declared feature costs no exchange of its own::

    ports = FlowFeature("src_ports", "src_port", "distinct")
    load = FlowFeature("mean_bytes", "header_len + payload_len", "sum", record="{value} / {packets}")
    flow_features(packets, features=[ports, load])
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowloom.schemas import FLOW_EXTRAS, FLOW_NAMES

PREFIX = "x_"
_KEPT = {"sum": "coalesce(sum({0}), 0)", "count": "count({0})", "min": "min({0})", "max": "max({0})", "distinct": "collect_set({0})"}


@dataclass(frozen=True)
class FlowFeature:
    """``packet`` is SQL over the columns of a packet, of type ``value_type``; nulls are no values. ``how`` is sum, count, min, max or
    distinct (the number of different values; they are kept, so they must come from a small domain, as ports do). ``record`` is
    SQL in which ``{value}`` is the result and ``{packets}`` the packets of the flow. Without values sum, count and distinct are 0, min and max null.
    """

    name: str
    packet: str
    how: str = "sum"
    value_type: str = "bigint"
    record: str = "{value}"

    def __post_init__(self):
        if not self.name.isidentifier() or self.name in FLOW_NAMES + FLOW_EXTRAS:
            raise ValueError(f"{self.name!r} is no name for a new flow column")
        if self.how not in _KEPT:
            raise ValueError(f"{self.how!r} is not one of {', '.join(_KEPT)}")

    @property
    def column(self) -> str:
        return PREFIX + self.name

    @property
    def kept(self) -> str:
        """Name of what a flow keeps; its ending says how two stretches of a flow are merged."""
        return f"{self.column}_{ {'sum': 'total', 'distinct': 'set'}.get(self.how, self.how) }"

    def aggregate(self) -> str:
        return f"{_KEPT[self.how].format(self.column)} as {self.kept}"

    def result(self) -> str:
        value = f"size({self.kept})" if self.how == "distinct" else self.kept
        return f"{self.record.format(value=value, packets='len_n')} as {self.name}"


def packet_values(features: Sequence[FlowFeature]) -> list[Column]:
    """The values of a packet, one column a feature."""
    names = [f.name for f in features]
    if len(set(names)) < len(names):
        raise ValueError(f"a feature is declared twice: {sorted(names)}")
    return [F.expr(f.packet).cast(f.value_type).alias(f.column) for f in features]


def value_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if c.startswith(PREFIX)]
