"""Incremental history: micro-batches of change events kept as an SCD table.

Three kinds of folders lie below the table, split into ``_bucket`` by hash of the key:

* ``log``: every usable event, append-only. Collapsed versions cannot be split again
  when a late event falls inside them; the events can.
* ``runs/.../_state=closed``: ended versions, append-only but for late events.
* ``runs/.../_state=open``: the one open version per key, rewritten for touched buckets.

Each batch writes a new generation of folders and makes it visible with one commit that
names the live folders, so a crashed batch leaves no trace and a replayed one is skipped.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lamella.operators.history import (
    INGESTED,
    VALID_FROM,
    VALID_TO,
    HistorySpec,
    as_versions,
    collapse_runs,
    scd1,
    usable_event,
)
from lamella.operators.skew import SkewPolicy, key_bucket, materialize, scratch_folder
from lamella.session import work_dir
from lamella.sources.commits import CommitLog
from lamella.sources.schemas import SchemaConflict, merge_schemas
from lamella.sources.tables import observed_rows

BUCKET, STATE, GEN = "_bucket", "_state", "_gen"
KEY_HASH = "integral keys as bigint"
MERGED = 8  # generations of a tier that become one of the next


def _as_type(field: T.StructField, wanted: T.DataType) -> Column:
    """The column as the table has it; nested types are widened when they are read."""
    nested = isinstance(wanted, (T.StructType, T.ArrayType, T.MapType))
    c = F.col(f"`{field.name}`")
    return c if nested or field.dataType == wanted else c.cast(wanted).alias(field.name)


class SilverTable:
    """History of keyed events below ``path``, maintained batch by batch.

    The parameters are those of ``scd2``. ``scd_type=1`` keeps the latest row per key and
    no log. ``buckets`` is fixed when the table is created: choose it so that the open
    versions of one bucket come to some 100 MB. One writer at a time.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        keys: Sequence[str],
        sequence_by: str = INGESTED,
        *,
        tie_break: Sequence[str] = (),
        tracked: Sequence[str] | None = None,
        untracked: Sequence[str] = (),
        drop: Sequence[str] = (),
        scd_type: int = 2,
        buckets: int = 64,
        skew: SkewPolicy | None = SkewPolicy(),
    ):
        if scd_type not in (1, 2):
            raise ValueError(f"scd_type must be 1 or 2, not {scd_type!r}")
        self._path, self._keys, self._sequence = path.rstrip("/"), list(keys), sequence_by
        self._roles = dict(tie_break=tie_break, tracked=tracked, untracked=untracked, drop=drop)
        self._type, self._skew = scd_type, skew
        self._log = CommitLog(spark, f"{self._path}/_commits")
        last = self._log.latest()
        self._buckets = last[1]["buckets"] if last else buckets

    # -- what is live ------------------------------------------------------------

    def _state(self) -> tuple[int, dict]:
        last = self._log.latest()
        if last:
            return last
        empty = {"buckets": self._buckets, "key_hash": KEY_HASH, "schema": None, "applied": {}, "log": {}}
        return -1, {**empty, "closed": {}, "open": {}, "opened": {}, "quarantine": []}

    def applied(self, stream: str = "batch") -> int:
        """Number of the last batch of ``stream`` that was applied; -1 before the first."""
        return self._state()[1]["applied"].get(stream, -1)

    @staticmethod
    def _schema(state: dict) -> T.StructType:
        return T.StructType.fromJson(json.loads(state["schema"]))

    def _run_schema(self, state: dict) -> T.StructType:
        payload = self._schema(state)
        seq = payload[self._sequence].dataType
        return T.StructType([*payload.fields, T.StructField(VALID_FROM, seq), T.StructField(VALID_TO, seq)])

    def _load(self, spark: SparkSession, part: str, schema: T.StructType, folders: Sequence[str]) -> DataFrame:
        """Folders of ``part`` as one frame, with generation and bucket as partition columns."""
        located = T.StructType([*schema.fields, T.StructField(GEN, T.StringType()), T.StructField(BUCKET, T.IntegerType())])
        if not folders:
            return spark.createDataFrame([], located)
        root = f"{self._path}/{part}"
        reader = spark.read.schema(located).option("basePath", root)
        return reader.parquet(*[f"{root}/{f}" for f in folders]).select(*located.names)

    def _open(self, spark: SparkSession, state: dict, buckets: Sequence[int] | None = None) -> DataFrame:
        """Live open runs. A generation of which every bucket is live is named by one folder."""
        live = {int(b): g for b, g in state["open"].items()}
        folders = []
        if buckets is None:
            for gen, written in state["opened"].items():
                mine = sorted(b for b, g in live.items() if g == gen)
                root = f"{GEN}={gen}/{STATE}=open"
                folders += [root] if len(mine) == written else [f"{root}/{BUCKET}={b}" for b in mine]
        else:
            folders = [f"{GEN}={live[b]}/{STATE}=open/{BUCKET}={b}" for b in buckets if b in live]
        return self._load(spark, "runs", self._run_schema(state), folders).drop(GEN, BUCKET)

    def _closed(self, spark: SparkSession, state: dict, buckets: Sequence[int] | None = None) -> DataFrame:
        """Live closed runs; a bucket of a generation that was rewritten later is left out."""
        folders = [f"{GEN}={g}/{STATE}=closed" for g in state["closed"]]
        df = self._load(spark, "runs", self._run_schema(state), folders)
        for gen, gone in state["closed"].items():
            if gone:
                df = df.where(~((F.col(GEN) == gen) & F.col(BUCKET).isin(gone)))
        return df if buckets is None else df.where(F.col(BUCKET).isin(list(buckets)))

    def _logged(self, spark: SparkSession, state: dict, gens: Sequence[str], usable: bool = True) -> DataFrame:
        folders = [f"{GEN}={g}/usable={str(usable).lower()}" for g in gens]
        return self._load(spark, "log", self._schema(state), folders)

    # -- reading -----------------------------------------------------------------

    def _spec(self, schema: T.StructType) -> HistorySpec:
        return HistorySpec.of(schema.names, self._keys, self._sequence, **self._roles)

    def read(self, spark: SparkSession) -> DataFrame:
        """The table as of the last commit; for type 1 without validity columns."""
        _, state = self._state()
        if state["schema"] is None:
            raise FileNotFoundError(f"no batch was applied to {self._path} yet")
        schema = self._schema(state)
        spec = self._spec(schema)
        opened = self._open(spark, state)
        if self._type == 1:
            return opened.select(*spec.output(schema.names))
        runs = opened.unionByName(self._closed(spark, state).drop(GEN, BUCKET))
        return as_versions(runs, spec, schema.names)

    def current(self, spark: SparkSession) -> DataFrame:
        """Open versions only; closed ones are not read."""
        _, state = self._state()
        schema = self._schema(state)
        opened = self._open(spark, state)
        return as_versions(opened, self._spec(schema), schema.names)

    def quarantined(self, spark: SparkSession) -> DataFrame:
        """Events left out for a null key or null sequence."""
        _, state = self._state()
        return self._logged(spark, state, state["quarantine"], usable=False).drop(GEN, BUCKET)

    # -- writing -----------------------------------------------------------------

    def apply(self, events: DataFrame, batch: int, stream: str = "batch") -> bool:
        """Apply one batch; False if batch number ``batch`` of ``stream`` was applied before.

        A batch may have further columns and wider types. Integral keys may change between
        integral types, as all of them hash alike; other changes of a key's type are refused.
        Dropped columns are not written, unless events are ordered by them.
        """
        spark = events.sparkSession
        number, state = self._state()
        if batch <= state["applied"].get(stream, -1):
            return False
        if state.get("key_hash") != KEY_HASH:
            raise ValueError(f"{self._path} was written with another hash of its keys; write it anew")
        hidden = {*self._roles["drop"]} - {self._sequence, *self._roles["tie_break"]}
        events = events.drop(*hidden)
        before = self._schema(state) if state["schema"] else T.StructType()
        schema = merge_schemas(before, events.schema)
        self._check_keys(before, schema)
        events = events.select(*[_as_type(f, schema[f.name].dataType) for f in events.schema.fields])
        state["schema"] = schema.json()
        gen = f"g{number + 1:08d}-{uuid.uuid4().hex[:8]}"
        scratch = work_dir(spark, "silver")
        # usable and unusable events are written in one pass over the batch
        marked = events.withColumns(
            {
                "usable": usable_event(self._keys, self._sequence),
                BUCKET: self._bucket(schema),
            }
        )
        incoming = f"{self._path}/log/{GEN}={gen}"
        counted = Observation()
        marked = marked.observe(counted, F.count_if("usable").alias("rows"))
        marked.hint("rebalance", "usable", BUCKET).write.partitionBy("usable", BUCKET).parquet(incoming)
        rows = observed_rows(counted)
        if self._log.exists(f"{incoming}/usable=false"):
            state["quarantine"].append(gen)
        state["applied"][stream] = batch
        if self._log.exists(f"{incoming}/usable=true"):
            batch_events = self._logged(spark, state, [gen]).drop(GEN)
            touched = sorted(int(n.split("=")[1]) for n in self._log.children(f"{incoming}/usable=true") if "=" in n)
            with scratch_folder(scratch):
                if self._type == 1:
                    runs, rewritten = self._apply_latest(spark, state, batch_events, touched), {}
                else:
                    state["log"][gen] = rows
                    runs, rewritten = self._apply_history(spark, state, batch_events, touched, rows)
                self._write_runs(runs, gen, state, touched, rewritten)
        self._log.commit(number + 1, state)
        self._log.delete_folder(scratch)
        self._maintain(spark)
        return True

    def _bucket(self, schema: T.StructType) -> Column:
        """Integral keys hash as bigint, so a key that is widened stays in its bucket."""
        integral = {k for k in self._keys if isinstance(schema[k].dataType, T.IntegralType)}
        return key_bucket([F.col(k).cast("long") if k in integral else F.col(k) for k in self._keys], self._buckets)

    def _check_keys(self, before: T.StructType, schema: T.StructType) -> None:
        for key in (k for k in self._keys if k in before.names):
            old, new = before[key].dataType, schema[key].dataType
            if old != new and not (isinstance(old, T.IntegralType) and isinstance(new, T.IntegralType)):
                raise SchemaConflict(f"key column {key} is {old.simpleString()}, new events have {new.simpleString()}")

    def _write_runs(self, runs: DataFrame, gen: str, state: dict, touched: list[int], rewritten: dict) -> None:
        out = runs.withColumns(
            {
                STATE: F.when(F.col(VALID_TO).isNull(), "open").otherwise("closed"),
                BUCKET: self._bucket(runs.schema),
            }
        )
        root = f"{self._path}/runs/{GEN}={gen}"
        out.hint("rebalance", STATE, BUCKET).write.partitionBy(STATE, BUCKET).parquet(root)
        for old, buckets in rewritten.items():
            state["closed"][old] = sorted({*state["closed"][old], *buckets})
        if self._log.exists(f"{root}/{STATE}=closed"):
            state["closed"][gen] = []
        state["open"].update({str(b): gen for b in touched})
        live = set(state["open"].values())
        state["opened"] = {g: n for g, n in {**state["opened"], gen: len(touched)}.items() if g in live}

    def _apply_latest(self, spark: SparkSession, state: dict, batch: DataFrame, touched: list[int]) -> DataFrame:
        schema = self._run_schema(state)
        stored = self._open(spark, state, touched).drop(VALID_FROM, VALID_TO)
        both = stored.unionByName(batch.drop(BUCKET))
        latest = scd1(both, self._keys, self._sequence, tie_break=self._roles["tie_break"])
        seq = schema[VALID_TO].dataType
        return latest.withColumns({VALID_FROM: F.col(self._sequence), VALID_TO: F.lit(None).cast(seq)})

    def _apply_history(
        self, spark: SparkSession, state: dict, batch: DataFrame, touched: list[int], rows: int
    ) -> tuple[DataFrame, dict[str, list[int]]]:
        """New runs of the touched buckets, and the closed folders they replace.

        Keys whose events all come after their open version only need that version. A key
        with a late event is derived again from the log, from the version the event falls
        into onwards; no earlier version can change.
        """
        keys, seq = self._keys, self._sequence
        spec = self._spec(self._schema(state))
        as_runs = batch.drop(BUCKET).withColumn(VALID_FROM, F.col(seq))
        if not any(str(b) in state["open"] for b in touched):
            return collapse_runs(as_runs, spec, self._check_for(rows)), {}
        opened = self._open(spark, state, touched).drop(VALID_TO)
        late = materialize(self._late_keys(opened, batch))
        found = late.agg(F.collect_set(BUCKET).alias("buckets"), F.min("_earliest").cast("string").alias("floor")).first()
        late_buckets = sorted(found.buckets)
        if not late_buckets:
            return collapse_runs(opened.unionByName(as_runs), spec, self._check_for(rows)), {}

        def not_before(column: str, floor: str) -> Column:
            """Coarse bound with a literal, which reaches the Parquet statistics."""
            return F.col(column) >= F.lit(floor).cast(batch.schema[seq].dataType)

        closed = self._closed(spark, state, late_buckets)
        bound = late.select(*keys, "_earliest", "_opened")
        hit = closed.where(not_before(VALID_TO, found.floor)).join(bound.select(*keys, "_earliest"), keys)
        hit = hit.where(F.col(VALID_TO) >= F.col("_earliest"))
        hit = materialize(hit.groupBy(*keys, GEN, BUCKET).agg(F.min(VALID_FROM).alias("_first")))
        replaced: dict[str, list[int]] = {}
        for place in hit.select(GEN, BUCKET).distinct().collect():
            replaced.setdefault(place[0], []).append(place[1])
        first_hit = hit.groupBy(*keys).agg(F.min("_first").alias("_first"))
        start = bound.join(first_hit, keys, "left").select(
            *keys, F.least("_earliest", "_opened", "_first").alias("_start")
        )

        floor = start.agg(F.min("_start").cast("string")).first()[0]
        events = self._logged(spark, state, list(state["log"]))
        events = events.where(F.col(BUCKET).isin(late_buckets) & not_before(seq, floor)).drop(GEN, BUCKET)
        suffix = events.join(start, keys).where(F.col(seq) >= F.col("_start")).drop("_start")
        in_order = opened.unionByName(as_runs).join(late.select(*keys), keys, "left_anti")
        every = in_order.unionByName(suffix.withColumn(VALID_FROM, F.col(seq)))
        runs = collapse_runs(every, spec, self._check_for(sum(state["log"].values())))
        if replaced:
            places = [(F.col(GEN) == g) & F.col(BUCKET).isin(bs) for g, bs in replaced.items()]
            kept = closed.where(reduce(lambda a, b: a | b, places)).join(start, keys, "left")
            kept = kept.where(F.col("_start").isNull() | (F.col(VALID_FROM) < F.col("_start")))
            runs = runs.unionByName(kept.select(*runs.columns))
        return runs, replaced

    def _late_keys(self, opened: DataFrame, batch: DataFrame) -> DataFrame:
        """Keys with an event not after the last one seen, by one aggregate over three columns."""
        keys, seq = self._keys, self._sequence
        nothing = F.lit(None).cast(batch.schema[seq].dataType)
        known = opened.select(*keys, F.col(seq).alias("_seen"), F.col(VALID_FROM).alias("_opened"), nothing.alias("_new"))
        new = batch.select(*keys, nothing.alias("_seen"), nothing.alias("_opened"), F.col(seq).alias("_new"))
        bounds = known.unionByName(new).groupBy(*keys).agg(
            F.max("_seen").alias("_seen"), F.max("_opened").alias("_opened"), F.min("_new").alias("_earliest")
        )
        late = bounds.where(F.col("_earliest") <= F.col("_seen"))
        return late.withColumn(BUCKET, self._bucket(late.schema))

    def compact(self, spark: SparkSession, keep: int = 8) -> None:
        """Fold all but the newest ``keep`` generations of closed runs and of the log into one each.

        The newest stay apart because late events mostly fall there, and what they touch
        is rewritten by generation and bucket.
        """
        number, state = self._state()
        old = {part: list(state[part])[:-keep] if keep else list(state[part]) for part in ("closed", "log")}
        if len(old["closed"]) < 2 and len(old["log"]) < 2:
            return
        for part, gens in old.items():
            if gens:
                self._fold(spark, state, part, gens, number + 1)
        self._log.commit(number + 1, state)

    def _maintain(self, spark: SparkSession) -> None:
        """Fold ``MERGED`` generations of one tier into one of the next.

        A row is written again once per tier, and live generations, folders read and the
        size of commits grow with the logarithm of the number of batches.
        """
        number, state = self._state()
        tiers, folded = state.setdefault("tiers", {}), False
        for part in ("closed", "log"):
            while True:
                by_tier: dict[int, list[str]] = {}
                for gen in state[part]:
                    by_tier.setdefault(tiers.get(f"{part}/{gen}", 0), []).append(gen)
                full = [(tier, gens) for tier, gens in by_tier.items() if len(gens) >= MERGED]
                if not full:
                    break
                tier, gens = min(full)
                new = self._fold(spark, state, part, gens, number + 1)
                if new:
                    tiers[f"{part}/{new}"] = tier + 1
                folded = True
        if folded:
            live = {f"{part}/{gen}" for part in ("closed", "log") for gen in state[part]}
            state["tiers"] = {k: v for k, v in tiers.items() if k in live}
            self._log.commit(number + 1, state)

    def _fold(self, spark: SparkSession, state: dict, part: str, gens: Sequence[str], number: int) -> str | None:
        """Write some generations of closed runs or of the log as one; None where no row is left."""
        gen = f"g{number:08d}-{uuid.uuid4().hex[:8]}"
        if part == "closed":
            runs = self._closed(spark, {**state, "closed": {g: state["closed"][g] for g in gens}}).drop(GEN)
            runs = runs.withColumn(STATE, F.lit("closed"))
            runs.hint("rebalance", BUCKET).write.partitionBy(STATE, BUCKET).parquet(f"{self._path}/runs/{GEN}={gen}")
            written = self._log.exists(f"{self._path}/runs/{GEN}={gen}/{STATE}=closed")
            new = {gen: []} if written else {}
        else:
            events = self._logged(spark, state, list(gens)).drop(GEN).withColumn("usable", F.lit(True))
            events.hint("rebalance", BUCKET).write.partitionBy("usable", BUCKET).parquet(f"{self._path}/log/{GEN}={gen}")
            written, new = True, {gen: sum(state["log"][g] for g in gens)}
        state[part] = {**new, **{g: v for g, v in state[part].items() if g not in set(gens)}}
        return gen if written else None

    def vacuum(self, keep_commits: int = 2) -> int:
        """Delete generations that none of the last commits names; run it between batches."""
        used = {"runs": set(), "log": set()}
        for number in self._log.numbers()[-keep_commits:]:
            state = self._log.get(number)
            used["runs"] |= {*state["closed"], *state["open"].values()}
            used["log"] |= {*state["log"], *state["quarantine"]}
        removed = 0
        for part, live in used.items():
            for name in self._log.children(f"{self._path}/{part}"):
                if name.startswith(f"{GEN}=") and name.removeprefix(f"{GEN}=") not in live:
                    self._log.delete_folder(f"{self._path}/{part}/{name}")
                    removed += 1
        return removed

    def _check_for(self, events: int) -> SkewPolicy | None:
        """No key can be too large when all events together are not; there is one open run per key."""
        return self._skew if self._skew and events > self._skew.min_rows else None

    def start(self, events: DataFrame, checkpoint: str, *, interval: str | None = None) -> StreamingQuery:
        """Apply a stream. Without ``interval`` it takes what is there, then stops.

        The name of the stream is kept next to the checkpoint, so that batch numbers of a
        new checkpoint are not taken for old ones.
        """
        checkpoint = checkpoint.rstrip("/")
        named = f"{checkpoint}.stream"
        if not self._log.exists(named):
            self._log.write_text(named, uuid.uuid4().hex)
        stream = self._log.read_text(named)
        writer = events.writeStream.option("checkpointLocation", checkpoint)
        writer = writer.foreachBatch(lambda df, number: self.apply(df, number, stream) and None)
        if interval:
            return writer.trigger(processingTime=interval).start()
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        return query
