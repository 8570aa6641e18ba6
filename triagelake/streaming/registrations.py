"""Keyed state as a stream: each micro-batch is folded into one value state a field and written as a new version.

A key's state holds, for each field, the last value that counts and the ``seq``
of its event, and the ``seq`` of the key's last deletion. So events may come in
any order and more than once: an older one changes nothing that a newer one
set, and what a deletion ends stays ended. What changed goes to the sink, which
lays it over the version before; a version is complete before a pointer is moved
to it, and a batch that is delivered again makes its own version again.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from triagelake.operators.state import EVENT_FIELDS, REGISTERED_RULES, shown
from triagelake.plans import boards
from triagelake.sources import sinks

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A store of one value a key (reviews, memos): the last value of all counts.
LAST_VALUE = {"value": ("value", "any")}


class KeyedFold(StatefulProcessor):
    """Folds a key's events by ``rules``: each kept field's source column and when a value of it counts.

    ``filled``: neither null nor empty, ``given``: not null, ``synced``: the event is a sync, ``any``: always.
    """

    def __init__(self, rules: dict[str, tuple[str, str]], first: str | None):
        self.rules, self.first = rules, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = {name: handle.getValueState(name, "value string, seq bigint") for name in self.rules}
        self.begun = handle.getValueState("begun", "value string, seq bigint")  # the first event behind the last deletion
        self.ended = handle.getValueState("ended", "seq bigint")
        self.later = handle.getMapState("later", "seq bigint", "value string")  # what would be first if a deletion came in late

    @staticmethod
    def _counts(rule: str, value, row) -> bool:
        return {"any": True, "given": value is not None, "filled": value not in (None, ""), "synced": rule == "synced" and bool(row["is_sync"])}[rule]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        ended = self.ended.get()[0] if self.ended.exists() else None
        kept = {name: tuple(s.get()) if s.exists() else None for name, s in self.kept.items()}
        begun = tuple(self.begun.get()) if self.begun.exists() else None
        before, over = (dict(kept), begun), ended
        for row in rows:
            seq = row["seq"]
            if row["op"] == "delete":
                ended = seq if ended is None else max(ended, seq)
            elif row["op"] == "upsert" and (ended is None or seq > ended):
                for name, (source, rule) in self.rules.items():
                    value = None if row[source] is None else str(row[source])
                    if self._counts(rule, value, row) and (kept[name] is None or kept[name][1] <= seq):
                        kept[name] = value, seq
                value = row[self.first] if self.first else None
                self.later.updateValue((seq,), (value,))
                if begun is None or seq < begun[1]:
                    begun = value, seq
        if ended != over:
            self.ended.update((ended,))
            gone = [k[0] for k in self.later.keys() if k[0] <= ended]
            for seq in gone:
                self.later.removeKey((seq,))
            kept = {name: v if v is not None and v[1] > ended else None for name, v in kept.items()}
            if begun is not None and begun[1] <= ended:
                left = min((k[0] for k in self.later.keys()), default=None)
                begun = None if left is None else (self.later.getValue((left,))[0], left)
        for name, state in [*self.kept.items(), ("begun", self.begun)]:
            new, old = (begun, before[1]) if name == "begun" else (kept[name], before[0][name])
            if new != old:
                state.clear() if new is None else state.update(new)
        yield Row(key=str(key[0]), live=begun is not None, first_status=begun[0] if begun else None, **{name: kept[name][0] if kept[name] else None for name in self.rules})

    def close(self) -> None:
        pass


def folded(events: DataFrame, key: str, rules: dict[str, tuple[str, str]], first: str | None = None) -> DataFrame:
    """A stream of the keys that a batch touched: ``key``, whether it is ``live``, the kept fields as text, and ``first_status``."""
    schema = "key string, live boolean, first_status string, " + ", ".join(f"{name} string" for name in rules)
    return events.groupBy(key).transformWithState(statefulProcessor=KeyedFold(rules, first), outputStructType=schema, outputMode="Update", timeMode="None")


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, where = sinks._fs(spark, f"{path}.d")
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith("version=") and fs.exists(sinks._fs(spark, f"{path}.d/{n}/_SUCCESS")[1]))


def write_versions(path: str):
    """A ``foreachBatch`` function: version N is version N - 1 with what batch N changed; the version before is kept, for batches that come again."""
    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        changed_path, version = f"{path}.d/batch={number}", f"version={number}"
        batch.write.mode("overwrite").parquet(changed_path)  # one pass of the fold; both uses below read what was written
        changed = spark.read.schema(batch.schema).parquet(changed_path)
        state = changed.where("live")
        older = [n for n in _versions(spark, path) if n < number]
        if older:
            kept = spark.read.schema(batch.schema).parquet(f"{path}.d/version={older[-1]}")
            state = state.unionByName(kept.join(changed.select("key"), "key", "left_anti"))
        state.write.mode("overwrite").parquet(f"{path}.d/{version}")
        sinks._point_to(spark, path, version)
        for name in [f"version={n}" for n in older[:-1]] + [f"batch={n}" for n in older]:
            fs, where = sinks._fs(spark, f"{path}.d/{name}")
            fs.delete(where, True)

    return run


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The committed version's rows; None before the first batch."""
    parts = sinks.current_parts(spark, path)
    return spark.read.parquet(parts.removesuffix("/part-*")) if parts else None


def current(spark: SparkSession, path: str) -> DataFrame:
    """The registered state as of the last batch: what ``merged`` gives over all events so far."""
    rows = stored(spark, path)
    if rows is None:
        columns = ", ".join(f"{c} string" for c in ("key", "first_status", *REGISTERED_RULES))
        rows = spark.createDataFrame([], columns)
    return shown(rows.withColumnRenamed("key", "research_id"))


def _start(rows: DataFrame, path: str, checkpoint: str):
    spark = rows.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)  # the store that keeps several states for a key; read when a query starts
    try:
        return rows.writeStream.foreachBatch(write_versions(path)).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def start(events: DataFrame, path: str, checkpoint: str):
    """Starts the stream of registration and sync events; ``availableNow`` drains what there is and ends."""
    return _start(folded(events.select(*EVENT_FIELDS), "research_id", REGISTERED_RULES, "status"), path, checkpoint)


def start_callbacks(urls: DataFrame, path: str, checkpoint: str):
    """The same from callback URLs (url, seq, at); what is delivered again folds to nothing new, since each field keeps its event's ``seq``."""
    events = urls.select("url", "seq", "at")
    return start(boards.callback_events(events, stream=True), path, checkpoint)


def start_values(events: DataFrame, path: str, checkpoint: str, key: str, value: str):
    """The same for a store of one value a key: events have ``key``, ``seq``, ``op`` and ``value``; ``stored`` gives key and value."""
    rows = events.selectExpr(f"`{key}` AS key", "seq", "op", f"CAST(`{value}` AS string) AS value")
    return _start(folded(rows, "key", LAST_VALUE), path, checkpoint)
