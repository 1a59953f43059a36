"""The semantic layer: compiled metrics by track, queried by name only."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywell.functions.predicates import ContractError, identifier
from tallywell.operators.metrics import Contract, compile_metric


@dataclass
class Semantic:
    """Metrics compiled in this process; a log takes every query."""

    log: object = None  # has query(dict)
    compiled: dict[tuple[str, str], tuple[Contract, DataFrame]] = field(default_factory=dict)

    def compile(self, track: str, fact: DataFrame, contract: Contract, contracts: Mapping[str, Contract] | None = None) -> DataFrame:
        """Register a metric and its temp view of the same name."""
        df = compile_metric(fact, contract, contracts)
        df.createOrReplaceTempView(contract.metric)
        self.compiled[track, contract.metric] = contract, df
        return df

    def frame(self, track: str, metric: str, limit: int | None = None) -> DataFrame:
        if (track, identifier(metric, "metric")) not in self.compiled:
            raise ContractError(f"{metric} isn't compiled for {track}")
        df = self.compiled[track, metric][1].select("dt", "value").orderBy(F.asc_nulls_last("dt"))
        return df.limit(int(limit)) if limit else df

    def query(self, track: str, metric: str, run_id: str, limit: int | None = None) -> dict:
        """Rows and provenance of one metric; only registered metrics, never SQL."""
        df = self.frame(track, metric, limit)
        contract = self.compiled[track, metric][0]
        rows = [[r["dt"], r["value"]] for r in df.collect()]
        out = {
            "query_id": f"q-{uuid.uuid4().hex[:12]}", "run_id": run_id, "track": track, "metric": metric,
            "metric_version": contract.version, "freshness": contract.max_delay, "rows": rows,
        }
        if self.log is not None:
            self.log.query({k: out[k] for k in ("query_id", "run_id", "track", "metric", "metric_version")} | {"via_semantic": True})
        return out
