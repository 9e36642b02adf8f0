"""Slowly changing dimensions: history of keyed change events (types 1 and 2).

An event is a row with a key, a sequence value and a payload. A *run* is a maximal
stretch of consecutive events of one key whose tracked columns agree; each run becomes
one version. A run is kept as its last event plus ``_valid_from``, the sequence of its
first event, so a single event is a run of length one and runs can be collapsed again.
That closure is what the sliced plan for large keys and the incremental table rest on.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.operators.skew import (
    SLICE,
    Skew,
    SkewPolicy,
    find_hot_keys,
    materialize,
    sketch_keys,
    split_hot,
    with_slices,
)

VALID_FROM, VALID_TO, IS_CURRENT = "_valid_from", "_valid_to", "_is_current"
INGESTED = "_ingestion_timestamp"


@dataclass(frozen=True)
class HistorySpec:
    """Which column plays which part in a history.

    ``untracked`` columns are kept, but a change in them opens no version; they show the
    value of the last event of the version. ``drop`` columns are left out of the result,
    after the ordering was read from them. Ordering columns are never tracked unless
    ``tracked`` names them.
    """

    keys: tuple[str, ...]
    sequence_by: str
    tie_break: tuple[str, ...]
    tracked: tuple[str, ...]
    payload: tuple[str, ...]
    drop: tuple[str, ...]

    @staticmethod
    def of(
        columns: Sequence[str],
        keys: Sequence[str],
        sequence_by: str = INGESTED,
        *,
        tie_break: Sequence[str] = (),
        tracked: Sequence[str] | None = None,
        untracked: Sequence[str] = (),
        drop: Sequence[str] = (),
    ) -> HistorySpec:
        if not keys:
            raise ValueError("at least one key column is needed")
        named = [*keys, sequence_by, *tie_break, *(tracked or ()), *untracked]
        missing = [c for c in named if c not in columns]
        if missing:
            raise ValueError(f"columns not found: {missing}; the input has {list(columns)}")
        if set(keys) & set(drop):
            raise ValueError("key columns cannot be dropped")
        if set(tracked or ()) & {*untracked, *drop}:
            raise ValueError("tracked columns cannot be untracked or dropped")
        if tracked is None:
            skipped = {*keys, sequence_by, *tie_break, *untracked, *drop}
            tracked = [c for c in columns if c not in skipped and not c.startswith("_")]
        return HistorySpec(
            keys=tuple(keys),
            sequence_by=sequence_by,
            tie_break=tuple(tie_break),
            tracked=tuple(tracked),
            payload=tuple(c for c in columns if c not in keys),
            drop=tuple(drop),
        )

    @property
    def by_end(self) -> tuple[str, ...]:
        """Columns taken from the last event of a run."""
        return tuple(c for c in self.payload if c not in self.tracked)

    def output(self, columns: Sequence[str]) -> list[str]:
        hidden = {*self.drop, VALID_FROM, VALID_TO, IS_CURRENT}
        return [c for c in columns if c not in hidden]


def _sortable(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return all(_sortable(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _sortable(dtype.elementType)
    return not isinstance(dtype, (T.MapType, T.VariantType))


def _total_order(df: DataFrame, spec: HistorySpec) -> list[str]:
    """Sequence, then tie break, then whatever else can be sorted.

    The rest makes the winner of a tie the same in every run.
    """
    first = [spec.sequence_by, *spec.tie_break]
    rest = [c for c in spec.payload if c not in first and _sortable(df.schema[c].dataType)]
    return first + rest


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _pair_heads_with_ends(df: DataFrame, spec: HistorySpec, window, head: str, end: str, to: Column | None):
    """Keep the rows opening a run, with the closing payload of that run and its end.

    ``df`` holds only opening and closing rows, so the closing row is the row itself or
    the one after it, and the next opening row follows directly.
    """
    closing = F.struct(*spec.by_end, *([to.alias("_to")] if to is not None else []))
    ended = F.col(end)
    paired = df.withColumns(
        {
            "_close": F.when(ended, closing).otherwise(F.lead(closing, 1).over(window)),
            "_next": F.when(ended, F.lead(VALID_FROM, 1).over(window)).otherwise(
                F.lead(VALID_FROM, 2).over(window)
            ),
        }
    ).where(F.col(head))
    valid_to = F.col("_next") if to is None else F.coalesce(F.col("_close._to"), F.col("_next"))
    return paired.withColumns({**{c: F.col(f"_close.{c}") for c in spec.by_end}, VALID_TO: valid_to})


def _collapse(df: DataFrame, spec: HistorySpec, within: Sequence[str]) -> DataFrame:
    """Collapse runs that lie in one window partition: one exchange, one sort.

    ``_opens`` marks the first run of each partition. All three windows share partition
    and order, so Catalyst sorts once for them.
    """
    window = Window.partitionBy(*within).orderBy(*_total_order(df, spec))
    seq = F.col(spec.sequence_by)
    # of several events at one sequence value the last one counts
    following = F.lead(seq).over(window)
    events = df.withColumn("_following", following).where(
        F.col("_following").isNull() | (F.col("_following") != seq)
    )
    tracked = [F.col(c) for c in spec.tracked]
    before = F.lag(F.lit(True)).over(window).isNull()
    after = F.lead(F.lit(True)).over(window).isNull()
    marked = events.withColumns(
        {
            "_opens": before,
            "_head": before | _any([~c.eqNullSafe(F.lag(c).over(window)) for c in tracked]),
            "_end": after | _any([~c.eqNullSafe(F.lead(c).over(window)) for c in tracked]),
        }
    ).where(F.col("_head") | F.col("_end"))
    runs = _pair_heads_with_ends(marked, spec, window, "_head", "_end", None)
    return runs.drop("_following", "_head", "_end", "_close", "_next")


def _collapse_sliced(df: DataFrame, spec: HistorySpec, slices: int) -> DataFrame:
    """The same result for keys too large for one task.

    Copies at one sequence value are combined before the first shuffle. Slices are
    collapsed on their own; then only the first and last run of every slice, two rows per
    slice, are compared per key. Runs in between are final already.
    """
    order = _total_order(df, spec)
    others = [c for c in df.columns if c not in {*spec.keys, *order}]
    whole = F.struct(*order, *others)
    if others and not all(_sortable(df.schema[c].dataType) for c in others):
        best = F.max_by(whole, F.struct(*order))
    else:
        best = F.max(whole)
    combined = df.groupBy(*spec.keys, F.col(spec.sequence_by).alias("_at")).agg(best.alias("_row"))
    combined = combined.select(*spec.keys, "_row.*")
    sliced = with_slices(combined, [*spec.keys, spec.sequence_by], slices)
    runs = materialize(_collapse(sliced, spec, [*spec.keys, SLICE]))

    at_edge = F.col("_opens") | F.col(VALID_TO).isNull()
    window = Window.partitionBy(*spec.keys).orderBy(VALID_FROM)
    same = reduce(
        lambda a, b: a & b,
        [F.col(c).eqNullSafe(F.lag(c).over(window)) for c in spec.tracked],
        F.lit(True),
    )
    first = F.lag(F.lit(True)).over(window).isNull()
    edges = runs.where(at_edge).withColumn("_head", first | ~(F.col("_opens") & same))
    edges = edges.withColumn("_end", F.coalesce(F.lead("_head").over(window), F.lit(True)))
    edges = edges.where(F.col("_head") | F.col("_end"))
    stitched = _pair_heads_with_ends(edges, spec, window, "_head", "_end", F.col(VALID_TO))
    inner = runs.where(~at_edge)
    return inner.unionByName(stitched.select(*inner.columns)).drop(SLICE)


def collapse_runs(df: DataFrame, spec: HistorySpec, skew: Skew = SkewPolicy()) -> DataFrame:
    """Collapse runs of the same key into maximal runs, adding ``_valid_to``.

    ``df`` has the payload, and ``_valid_from`` for the start of each row's run; the runs
    of a key must not overlap. With ``skew=None`` the check for large keys is left out; with
    a sketch of the keys nothing is counted here.
    """
    hot = find_hot_keys(df, spec.keys, skew)
    if hot is None:
        return _collapse(df, spec, spec.keys).drop("_opens")
    cold, large = split_hot(df, spec.keys, hot)
    cold_runs = _collapse(cold, spec, spec.keys).drop("_opens")
    return cold_runs.unionByName(_collapse_sliced(large, spec, hot.slices).drop("_opens"))


def usable_event(keys: Sequence[str], sequence_by: str) -> Column:
    """Neither the sequence nor any key column is null."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, sequence_by]])


def split_null_keys(df: DataFrame, keys: Sequence[str], sequence_by: str) -> tuple[DataFrame, DataFrame]:
    """(usable events, events with a null key or null sequence)."""
    usable = usable_event(keys, sequence_by)
    return df.where(usable), df.where(~usable)


def scd2(
    events: DataFrame,
    keys: Sequence[str],
    sequence_by: str = INGESTED,
    *,
    tie_break: Sequence[str] = (),
    tracked: Sequence[str] | None = None,
    untracked: Sequence[str] = (),
    drop: Sequence[str] = (),
    skew: Skew = SkewPolicy(),
) -> DataFrame:
    """One row per version of each key, closed by the start of the next one.

    Order comes from ``sequence_by`` and never from arrival. Of several events of a key at
    the same sequence value the last by ``tie_break`` wins. Events with a null key or
    sequence are left out; ``split_null_keys`` returns them. Adds the half-open validity
    ``_valid_from``, ``_valid_to`` (null while open) and ``_is_current``.
    """
    spec = HistorySpec.of(
        events.columns, keys, sequence_by, tie_break=tie_break, tracked=tracked, untracked=untracked, drop=drop
    )
    usable, _ = split_null_keys(events, keys, sequence_by)
    used = usable.select(*[c for c in events.columns if c not in spec.drop or c in _ordering(spec)])
    spec = _narrow(spec, used.columns)
    runs = collapse_runs(used.withColumn(VALID_FROM, F.col(sequence_by)), spec, skew)
    return as_versions(runs, spec, events.columns)


def _ordering(spec: HistorySpec) -> tuple[str, ...]:
    return (spec.sequence_by, *spec.tie_break)


def _narrow(spec: HistorySpec, columns: Sequence[str]) -> HistorySpec:
    kept = tuple(c for c in spec.payload if c in columns)
    return HistorySpec(spec.keys, spec.sequence_by, spec.tie_break, spec.tracked, kept, spec.drop)


def as_versions(runs: DataFrame, spec: HistorySpec, columns: Sequence[str]) -> DataFrame:
    """Public columns of a history, in the order of the input."""
    return runs.select(
        *spec.output(columns), VALID_FROM, VALID_TO, F.col(VALID_TO).isNull().alias(IS_CURRENT)
    )


def scd1(
    events: DataFrame,
    keys: Sequence[str],
    sequence_by: str = INGESTED,
    *,
    tie_break: Sequence[str] = (),
    drop: Sequence[str] = (),
) -> DataFrame:
    """Latest row per key. One shuffle; each map task sends one row per key at most."""
    spec = HistorySpec.of(events.columns, keys, sequence_by, tie_break=tie_break, tracked=(), drop=drop)
    usable, _ = split_null_keys(events, keys, sequence_by)
    order = _total_order(events, spec)
    others = [c for c in spec.payload if c not in order and c not in spec.drop]
    kept = [c for c in order if c in _ordering(spec) or c not in spec.drop]
    if others:
        best = F.max_by(F.struct(*kept, *others), F.struct(*kept))
    else:
        best = F.max(F.struct(*kept))
    latest = usable.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")
    return latest.select(*[c for c in events.columns if c not in spec.drop])


def current(history: DataFrame) -> DataFrame:
    """The open version of each key."""
    return history.where(F.col(VALID_TO).isNull())


def as_of(history: DataFrame, moment) -> DataFrame:
    """The versions valid at ``moment``, a value or a column.

    A time without a zone is taken as wall-clock time, in the session's zone where the
    sequence has one.
    """
    if isinstance(moment, datetime) and moment.tzinfo is None:
        moment = F.lit(moment.isoformat(" ")).cast(history.schema[VALID_FROM].dataType)
    at = moment if isinstance(moment, Column) else F.lit(moment)
    return history.where((F.col(VALID_FROM) <= at) & (F.col(VALID_TO).isNull() | (at < F.col(VALID_TO))))


def temporal_join(
    facts: DataFrame,
    history: DataFrame,
    on: Sequence[str],
    at: str,
    *,
    how: str = "inner",
    skew: Skew = SkewPolicy(),
) -> DataFrame:
    """Join each fact to the version of its key valid at the fact's time.

    Facts and versions are laid out together by key and time, and each fact takes the last
    version before it: one shuffle and one sort, linear in the rows, where an equality join
    with a range condition would pair every fact with every version of its key first.
    ``on`` names the key columns, present on both sides; the other columns must differ.
    Sketches of facts and of the events behind a history, added up, may be handed on as
    ``skew``; else both sides are counted.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, not {how!r}")
    fact_columns = [c for c in facts.columns if c not in on]
    version_columns = [c for c in history.columns if c not in on]
    shared = set(fact_columns) & set(version_columns)
    if shared:
        raise ValueError(f"rename these columns on one side first: {sorted(shared)}")
    if isinstance(skew, SkewPolicy):
        skew = sketch_keys(facts, on, skew) + sketch_keys(history, on, skew)
    hot = skew.hot() if skew else None
    if hot:
        history = materialize(history)  # both routes read it; a lazy one would be computed for each
    fact, version = F.struct(*fact_columns), F.struct(*version_columns)
    no_fact = F.lit(None).cast(facts.select(fact.alias("f")).schema["f"].dataType)
    no_version = F.lit(None).cast(history.select(version.alias("v")).schema["v"].dataType)
    keyed, unkeyed = split_null_keys(facts, on, at)
    rows = keyed.select(
        *on, F.col(at).alias("_at"), F.lit(1).alias("_side"), fact.alias("_fact"), no_version.alias("_version")
    ).unionByName(
        history.where(~_any([F.col(c).isNull() for c in on])).select(
            *on,
            F.col(VALID_FROM).alias("_at"),
            F.lit(0).alias("_side"),
            no_fact.alias("_fact"),
            version.alias("_version"),
        )
    )
    if hot is None:
        met = _fill_forward(rows, on).where(F.col("_side") == 1)
    else:
        cold, large = split_hot(rows, on, hot)
        met = _fill_forward(cold, on).where(F.col("_side") == 1)
        met = met.unionByName(_fill_forward_sliced(large, on, hot.slices).select(*met.columns))
    valid_to = F.col(f"_version.{VALID_TO}")
    inside = F.col("_version").isNotNull() & (valid_to.isNull() | (F.col("_at") < valid_to))
    if how == "inner":
        return met.where(inside).select(*on, "_fact.*", "_version.*")
    met = met.withColumn("_version", F.when(inside, F.col("_version")))
    joined = met.select(*on, "_fact.*", "_version.*")
    return joined.unionByName(unkeyed, allowMissingColumns=True)


def _fill_forward(rows: DataFrame, within: Sequence[str]) -> DataFrame:
    window = Window.partitionBy(*within).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_version", F.last("_version", ignorenulls=True).over(window))


def _fill_forward_sliced(rows: DataFrame, on: Sequence[str], slices: int) -> DataFrame:
    """Fill within slices, then hand the last version of each slice on to the next ones."""
    fixed = materialize(rows)
    # positions in a written table do not change, so copies can be told apart by them
    numbered = fixed.withColumn("_copy", F.monotonically_increasing_id())
    sliced = with_slices(numbered, [*on, "_at", "_side", "_copy"], slices).drop("_copy")
    filled = materialize(_fill_forward(sliced, [*on, SLICE]))
    per_slice = filled.groupBy(*on, SLICE).agg(
        F.max_by(F.when(F.col("_side") == 0, F.col("_version")), F.when(F.col("_side") == 0, F.col("_at"))).alias(
            "_last"
        )
    )
    earlier = Window.partitionBy(*on).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_slice.select(*on, SLICE, F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    found = filled.where((F.col("_side") == 1) & F.col("_version").isNotNull())
    open_facts = filled.where((F.col("_side") == 1) & F.col("_version").isNull())
    handed = open_facts.join(carried.where(F.col("_carried").isNotNull()), [*on, SLICE], "left")
    return found.unionByName(handed.withColumn("_version", F.col("_carried")).select(*found.columns))
