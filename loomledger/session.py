"""A ledger opened for queries: its views under their names, SQL with parameters, health and conflicts."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomledger.operators.fold import Fold

VIEWS = ("_events", "entries", "tally", "tally_moves", "conflicts", "records")


class Ledger:
    """events: seq, id, type, actor, device_id, ts_device, payload."""

    def __init__(self, events: DataFrame) -> None:
        self.spark: SparkSession = events.sparkSession
        self.fold = Fold(events)
        self._events = self.fold.events.select(*events.columns)

    def view(self, name: str) -> DataFrame:
        """One view; only tally, tally_moves, conflicts and records fold the moves."""
        return self._events if name == "_events" else getattr(self.fold, name)()

    def views(self) -> dict[str, DataFrame]:
        return {name: self.view(name) for name in VIEWS}

    def query(self, sql: str, params: dict[str, Any] | list | None = None) -> DataFrame:
        """SELECT over the views; named parameters may be written :x, $x or @x, positional ones as ?. What would change anything is refused before it runs."""
        if isinstance(params, dict):
            params = {k.lstrip("$:@"): v for k, v in params.items()}
            sql = _QUOTED_OR_NAME.sub(lambda m: m[0] if m["quoted"] else f":{m['name']}", sql)
        if not _only_reads(self.spark, sql):
            raise ValueError("only queries are run here; events are appended, settings have calls of their own")
        # names are compared as the engine does, without case; only views that are named are built
        named = {w.lower() for w in re.findall(r"\w+", _LITERAL.sub(" ", sql))}
        for name in VIEWS:
            if name in named:
                self.view(name).createOrReplaceTempView(name)
        return self.spark.sql(sql, args=params) if params else self.spark.sql(sql)

    def conflicts(self) -> DataFrame:
        return self.fold.conflicts().filter("status = 'open'")

    def health(self, scan: DataFrame | None = None) -> DataFrame:
        """One row: events, skipped as unfit, and from the log's scan: lines quarantined, torn tails repaired, and the seqs behind gaps."""
        own = self.fold.typed.agg(F.count("*").alias("events"), F.count_if(F.col("poison_reason").isNotNull()).alias("skipped"))
        if scan is None:
            return own.withColumns({"quarantined": F.lit(0).cast("long"), "repaired_tail": F.lit(False), "gaps": F.array().cast("array<long>")})
        of_log = scan.agg(
            F.count_distinct(F.when(F.col("state").isin("bad", "torn"), F.sha2("raw", 256))).alias("quarantined"),
            F.coalesce(F.bool_or(F.col("state") == "torn"), F.lit(False)).alias("repaired_tail"),
            F.array_sort(F.collect_list(F.when(F.col("gap"), F.get_json_object("text", "$.seq").try_cast("long")))).alias("gaps"),
        )
        return own.crossJoin(F.broadcast(of_log))  # one row each

    def point(self, event_id: str) -> DataFrame:
        return self._events.filter(F.col("id") == event_id)


#: Text that no parameter stands in (literals, names in quotes, comments), or a parameter.
_QUOTED_OR_NAME = re.compile(r"""(?s)(?P<quoted>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/)|[$@](?P<name>\w+)""")
#: Texts and comments, in which no view is named.
_LITERAL = re.compile(r"(?s)'(?:[^'\\]|\\.)*'|--[^\n]*|/\*.*?\*/")
_WRITES = ("org.apache.spark.sql.catalyst.plans.logical.Command", "org.apache.spark.sql.catalyst.plans.logical.ParsedStatement")


def _only_reads(spark: SparkSession, sql: str) -> bool:
    """Whether the parsed statement holds no command and no write, at any depth."""
    loader = spark._jvm.Thread.currentThread().getContextClassLoader()
    writes = [loader.loadClass(name) for name in _WRITES]
    todo = [spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)]
    while todo:
        plan = todo.pop()
        if any(c.isInstance(plan) for c in writes):
            return False
        for below in (plan.children(), plan.innerChildren()):
            todo += [x for i in range(below.size()) if loader.loadClass("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan").isInstance(x := below.apply(i))]
    return True
