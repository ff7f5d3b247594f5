"""Monthly check-ins: validation and derived fields, as a stream and as a batch job."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from panelwright.functions.numeric import adherence_band, adherence_share, clamp_probability

LAST_STEP = 12
INPUT = (
    "request_id long, entity_id long, month int, weight double, height double, smear_tb_lamp int, "
    "xpert_mtb_rif int, monthly_doses_taken int, monthly_missed_doses int, "
    "failure_probability double, timestamp long"
)
FLAGGED = (
    "weight", "height", "smear_tb_lamp", "xpert_mtb_rif", "monthly_doses_taken",
    "monthly_missed_doses",
)
VERDICT = f"{INPUT}, accepted boolean, reason string, expected_month int, prior_doses long"
STATE = "last_month int, doses long"
REPEATED, UNKNOWN = "repeated", "unknown_entity"
#: What the register knows of an entity before its check-ins: -1 and null where there is no record.
REGISTER = "entity_id long, last_month int, doses long, probability double"
JUDGED = f"{VERDICT}, previous_probability double"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _settle_early(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Verdicts that need no history, before any shuffle.

    Marks rows that fail on their own and, inside an Arrow batch, rows of a month another
    row of the entity precedes: neither can be accepted. What is left of a busy entity is
    at most one row per month and batch.
    """
    for batch in batches:
        month = batch["month"]
        lacking = batch["monthly_doses_taken"].isna() | batch["monthly_missed_doses"].isna()
        early = pd.Series(None, index=batch.index, dtype="object")
        early[(month > 0) & lacking] = "doses_required"
        early[~month.between(0, LAST_STEP)] = "month_out_of_range"
        open_rows = batch[early.isna()].sort_values(["timestamp", "request_id"], kind="stable")
        again = open_rows.duplicated(["entity_id", "month"])
        early.loc[again.index[again]] = REPEATED
        yield batch.assign(early=early)


def _judge(frame: pd.DataFrame, last: int, doses: int) -> tuple[pd.DataFrame, int, int]:
    """Verdicts of an entity's rows in month order, and its last month and doses after them."""
    frame = frame.sort_values(["month", "timestamp", "request_id"], kind="stable")
    again = frame.duplicated("month")
    verdicts = []
    for row, repeated in zip(frame.itertuples(index=False), again):
        month = int(row.month)
        expected = last + 1 if last >= 0 else min(month, 1)
        if last >= 0 and month <= last and not repeated:
            reason = "duplicate_or_past"
        elif repeated:
            reason = REPEATED
        else:
            reason = None if month == expected else "unexpected_month"
        verdicts.append((reason is None, reason, expected, doses))
        if reason is None:
            last = month
            doses += 0 if pd.isna(row.monthly_doses_taken) else int(row.monthly_doses_taken)
    extra = pd.DataFrame(verdicts, columns=["accepted", "reason", "expected_month", "prior_doses"])
    return pd.concat([frame.reset_index(drop=True), extra], axis=1), last, doses


def _validate(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    last, doses = state.get if state.exists else (-1, 0)
    verdicts, last, doses = _judge(pd.concat(list(batches), ignore_index=True), last, doses)
    state.update((last, doses))
    yield verdicts


class RegisteredCheckins(StatefulProcessor):
    """Judges check-ins of entities that the register holds; others are rejected.

    Per entity the state is its progress (last month and doses) and its latest predictions. With
    ``grows``, entities may be registered in the same batch, after their first check-ins. Most
    entities have a handful of rows, so rows are judged as they are, with no frame per entity, and
    state is written only where it changes. A verdict carries the columns ``kept`` of its row:
    every column that crosses over costs, so the stream keeps one that holds the whole check-in.
    """

    def __init__(self, grows: bool = False, kept: Sequence[str] | None = None):
        self.grows = grows
        self.kept = _names(INPUT) if kept is None else list(kept)
        self.made = Row(*self.kept, *_names(_OUTCOME))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.progress = handle.getValueState("progress", "last_month int, doses long")
        self.recent = handle.getListState("recent", "month int, probability double")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self._register(initialState)  # the furthest of an entity's records, and before any check-in

    def _register(self, known: Row) -> tuple[int, int]:
        last = -1 if known["last_month"] is None else known["last_month"]
        progress = (last, known["doses"] or 0)
        self.progress.update(progress)
        if _stated(known["probability"]):
            self.recent.put([(last, known["probability"])])
        return progress

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        progress, waiting, news = self.progress.get(), [], []
        for row in rows:
            if self.grows and row["registers"]:
                news.append(row)
            elif progress is None and not self.grows:
                yield self._verdict(row, False, UNKNOWN)
            elif progress is not None and row["early"] is not None:
                yield self._verdict(row, False, row["early"])  # at once, so a busy entity is never held whole
            else:
                waiting.append(row)
        if progress is None and news:  # of several records the furthest counts
            progress = self._register(max(news, key=lambda r: [(r[c] is not None, r[c] or 0) for c in ("last_month", "doses")]))
        if progress is None:
            for row in waiting:
                yield self._verdict(row, False, UNKNOWN)
            return
        rest = []
        for row in waiting:
            if row["early"] is None:
                rest.append(row)
            else:
                yield self._verdict(row, False, row["early"])
        if not rest:
            return
        last, doses = progress
        recent = [(r[0], r[1]) for r in self.recent.get()]
        before, months = len(recent), set()
        for row in sorted(rest, key=lambda r: [(r[c] is None, r[c] or 0) for c in ("month", "timestamp", "request_id")]):
            month = row["month"]
            expected = last + 1 if last >= 0 else min(month, 1)
            reason = None if month == expected else "unexpected_month"
            if month in months:
                reason = REPEATED
            elif 0 <= last >= month:
                reason = "duplicate_or_past"
            months.add(month)
            yield self._verdict(row, reason is None, reason, expected, doses, recent[-1][1] if recent else None)
            if reason is None:
                last, doses = month, doses + (row["monthly_doses_taken"] or 0)
                if _stated(row["failure_probability"]):
                    recent.append((month, row["failure_probability"]))
        if (last, doses) != tuple(progress):
            self.progress.update((last, doses))
        if len(recent) > before:
            self.recent.put(recent[-3:])

    def _verdict(
        self, row: Row, accepted: bool, reason: str | None, expected: int | None = None, prior: int | None = None,
        before: float | None = None,
    ) -> Row:
        return self.made(*[row[c] for c in self.kept], accepted, reason, expected, prior, before)

    def close(self) -> None:
        pass


def _stated(p: float | None) -> bool:
    return p is not None and p == p


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


#: What a check-in is judged by; ``whole`` is the check-in itself, as JSON.
JUDGED_BY = ("whole", "month", "timestamp", "request_id", "monthly_doses_taken", "failure_probability", "early", "entity_id")
_OUTCOME = JUDGED[len(INPUT) + 2 :]


def registered_stream(stream: DataFrame, register: DataFrame, registrations: DataFrame | None = None) -> DataFrame:
    """Verdicts of a stream of check-ins against the register, with the previous prediction.

    ``register`` (see ``REGISTER``) becomes the state before the first row, so it is read once
    and never joined to a batch; ``registrations``, a stream of the same columns, adds entities
    later. An unknown entity is the first reason to reject; the others are as in
    :func:`validated_stream`. Rows with a null entity are unknown.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    typed = stream.selectExpr(*[f"cast({n} as {k}) as {n}" for n, k in (c.split() for c in INPUT.split(", "))])
    marked = typed.mapInPandas(_settle_early, f"{INPUT}, early string")
    marked = marked.withColumn("whole", F.to_json(F.struct(*_names(INPUT)))).select(*JUDGED_BY)
    known = [f"cast({n} as {k}) as {n}" for n, k in (c.split() for c in REGISTER.split(", "))]
    if registrations is not None:
        extra = {"registers": F.lit(False), "last_month": F.lit(None).cast("int"), "doses": F.lit(None).cast("long"),
                 "probability": F.lit(None).cast("double")}
        marked = marked.withColumns(extra)
        fresh = registrations.selectExpr(*known).withColumn("registers", F.lit(True))
        missing = [f for f in marked.schema if f.name not in fresh.columns]
        marked = marked.unionByName(fresh.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}))
    fields = _names(REGISTER)[1:]
    start = register.filter("entity_id is not null").selectExpr(*known).groupBy("entity_id").agg(F.max(F.struct(*fields)).alias("_known"))
    judged = marked.groupBy("entity_id").transformWithState(
        RegisteredCheckins(registrations is not None, ["whole"]), T.StructType.fromDDL(f"whole string, {_OUTCOME}"), "append", "none",
        start.select("entity_id", *[F.col(f"_known.{c}").alias(c) for c in fields]).groupBy("entity_id"))
    return judged.withColumn("_row", F.from_json("whole", INPUT)).select("_row.*", *_names(_OUTCOME))


def prediction_rows(verdicts: DataFrame) -> DataFrame:
    """One prediction per accepted check-in, with the change since the one before."""
    p, before = clamp_probability(F.col("failure_probability")), clamp_probability(F.col("previous_probability"))
    return verdicts.filter("accepted and failure_probability is not null").select(
        "request_id", "entity_id", "month", (p >= 0.5).cast("int").alias("label"), p.alias("failure_probability"),
        before.alias("previous_probability"), (p - before).alias("change"), "timestamp")


def validated_stream(stream: DataFrame) -> DataFrame:
    """Accepted and rejected check-ins of a stream; state is two numbers per entity.

    Rows of one micro-batch are judged in month order, whatever order they came in.
    """
    typed = stream.selectExpr(
        *[f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in INPUT.split(", ")]
    )
    marked = typed.mapInPandas(_settle_early, f"{INPUT}, early string")
    settled = marked.filter("early is not null").select(
        *typed.columns, F.lit(False).alias("accepted"), F.col("early").alias("reason"),
        F.lit(None).cast("int").alias("expected_month"), F.lit(None).cast("long").alias("prior_doses"),
    )
    judged = marked.filter("early is null").drop("early").groupBy("entity_id").applyInPandasWithState(
        _validate, VERDICT, STATE, "append", "NoTimeout"
    )
    return judged.unionByName(settled)


def derived_fields(verdicts: DataFrame) -> DataFrame:
    """Adherence, cumulative doses, missing flags and clamped risk of accepted check-ins."""
    taken, missed = F.col("monthly_doses_taken"), F.col("monthly_missed_doses")
    return with_derivations(
        verdicts.filter("accepted"), taken, missed, F.col("prior_doses")
    ).drop("accepted", "reason", "prior_doses")


def with_derivations(df: DataFrame, taken: Column, missed: Column, prior: Column) -> DataFrame:
    share = adherence_share(taken, missed)
    flags = {f"is_missing_{c}": F.col(c).isNull().cast("int") for c in FLAGGED}
    return df.withColumns(
        {
            "pct_adherence": share,
            "adherence": adherence_band(share),
            "cumulative_doses_taken": prior + taken,
            "failure_probability": clamp_probability(F.col("failure_probability")),
            **flags,
        }
    )


def validated_batch(df: DataFrame, register: DataFrame | None = None) -> DataFrame:
    """The same verdicts for a complete table, with joins and windows only.

    Rows that fail on their own are judged alone. Of the others, the first of each
    (entity, month) competes and later ones are repeats; a month is accepted while months run
    without a gap from 0 or 1, or from the last month that ``register`` (see ``REGISTER``)
    holds. With a register, rows of entities that it lacks are rejected first. An entity
    contributes at most 13 competing months, so its window stays short however many repeats
    it sent.
    """
    month = F.col("month")
    out_of_range = ~F.coalesce(month.between(0, LAST_STEP), F.lit(False))
    no_doses = (month > 0) & (
        F.col("monthly_doses_taken").isNull() | F.col("monthly_missed_doses").isNull()
    )
    own = F.when(out_of_range, "month_out_of_range").when(no_doses, "doses_required")
    if register is None:
        base = df.withColumns({"_own": own, "_last": F.lit(-1), "_doses": F.lit(0).cast("long")})
    else:
        furthest = F.max(F.struct(F.coalesce("last_month", F.lit(-1)).alias("m"), F.coalesce("doses", F.lit(0)).alias("d")))
        known = register.groupBy(F.col("entity_id").alias("_entity")).agg(furthest.alias("_known"))
        base = df.join(known, F.col("entity_id") == F.col("_entity"), "left").withColumns({
            "_own": F.when(F.col("_entity").isNull(), UNKNOWN).otherwise(own),
            "_last": F.col("_known.m").cast("int"), "_doses": F.col("_known.d").cast("long")}).drop("_entity", "_known")
    order = Window.partitionBy("entity_id", "month").orderBy("timestamp", "request_id")
    ok = base.filter("_own is null")
    firsts = ok.withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    w = Window.partitionBy("entity_id", "_past").orderBy("month")
    past = month <= F.col("_last")
    chain = firsts.withColumn("_past", past).select(
        "entity_id", "month", "_past", "_last", "_doses", F.col("request_id").alias("_winner"),
        F.coalesce("monthly_doses_taken", F.lit(0)).cast("long").alias("_taken"),
        (month - F.row_number().over(w)).alias("_island"),
        F.min("month").over(Window.partitionBy("entity_id", "_past")).alias("_first"),
    )
    start = F.when(F.col("_last") >= 0, F.col("_first") == F.col("_last") + 1).otherwise(F.col("_first") <= 1)
    unbroken = ~F.col("_past") & start & (F.col("_island") == F.col("_first") - 1)
    # Accepted months open the chain, so a running sum up to one of them sees only accepted rows.
    months = chain.select(
        "entity_id", "month", F.col("_winner").alias("_first_id"), unbroken.alias("_ok"), F.col("_past").alias("_over"),
        (F.col("_doses") + F.sum("_taken").over(w) - F.col("_taken")).alias("prior_doses"),
    )
    joined = base.join(months, ["entity_id", "month"], "left")
    mine = F.col("_own").isNull() & (F.col("_first_id") == F.col("request_id"))
    won = F.coalesce(mine & F.col("_ok"), F.lit(False))
    reason = (
        F.when(F.col("_own").isNotNull(), F.col("_own"))
        .when(F.col("_first_id") != F.col("request_id"), REPEATED)
        .when(F.col("_over"), "duplicate_or_past")
        .when(~won, "unexpected_month")
    )
    return joined.select(
        *df.columns, won.alias("accepted"), reason.alias("reason"),
        F.when(won, F.col("prior_doses")).alias("prior_doses"),
    )
