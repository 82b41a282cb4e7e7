from pagelake.workload import (  # noqa: F401  each registers its queries
    cleaning,
    collection,
    dedup_joins,
    ledgers,
    scalars,
    scans_sinks,
    streams,
)
from pagelake.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
