"""Transfer events to validity intervals, point-in-time lookups, and the timeline assignment.

``slots_by_lead`` is the declarative form for events that each end the interval before; ``build_slots`` is the full state
machine, one ordered fold per party. ``recommend_timeline`` is a Viterbi fold per name over stored candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date, timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def slots_by_lead(events: DataFrame, party: str, unit: str, at: str, tie: str) -> DataFrame:
    """(party, unit, active_from, active_to, previous_unit, next_unit): runs of one unit, each ended by the next run's start."""
    w = W.partitionBy(party).orderBy(at, tie)
    runs = events.withColumn("__before", F.lag(unit).over(w)).where(F.col("__before").isNull() | (F.col("__before") != F.col(unit)))
    return runs.select(party, unit, F.col(at).alias("active_from"), F.lead(at).over(w).alias("active_to"), F.col("__before").alias("previous_unit"), F.lead(unit).over(w).alias("next_unit"))


def movement_summary(history: DataFrame, party: str, unit: str, order: list[str], before: int = 3) -> DataFrame:
    """(party, current, previous, units): the last unit, up to ``before`` different ones before it (the latest first) and how many
    different units there were."""
    w = W.partitionBy(party).orderBy(*order)
    runs = history.withColumn("__b", F.lag(unit).over(w)).where((F.col(unit) != "") & (F.col("__b").isNull() | (F.col("__b") != F.col(unit))))
    last = runs.groupBy(party, unit).agg(F.max(F.struct(*order)).alias("__at"))
    back = last.groupBy(party).agg(F.transform(F.sort_array(F.collect_list(F.struct("__at", F.col(unit).alias("u"))), asc=False), lambda x: x["u"]).alias("b"))
    return back.select(party, F.get("b", F.lit(0)).alias("current"), F.slice("b", 2, before).alias("previous"), F.size("b").alias("units"))


@dataclass
class _Slot:
    number: int
    unit: str
    title: str
    start: str
    end: str = ""
    confidence: float = 0.0
    previous: int | None = None
    next: int | None = None
    events: int = 1


def _day_before(day: str) -> str:
    try:
        return (date.fromisoformat(day[:10]) - timedelta(days=1)).isoformat()
    except ValueError:
        return day


def _match(open_slots: list[_Slot], unit: str) -> _Slot | None:
    """The open slot of a unit: equal first, then overlapping names, then the latest start."""
    if not unit:
        return None
    near = [(s.unit == unit, s.start, s) for s in open_slots if s.unit and (s.unit == unit or s.unit in unit or unit in s.unit)]
    return max(near, key=lambda x: x[:2])[2] if near else None


@dataclass
class SlotFold:
    """State of one party: events in order move it between open slots."""

    full_name: bool = True
    slots: list[_Slot] = field(default_factory=list)
    open: list[_Slot] = field(default_factory=list)

    def step(self, day: str, from_unit: str, to_unit: str, title: str, confidence: float | None) -> None:
        current, previous = _match(self.open, to_unit), _match(self.open, from_unit)
        if current is not None and current is previous:
            self._update(current, title, confidence)
            return
        if previous is not None:
            previous.end = _day_before(day) if day else ""
            self.open.remove(previous)
        if not to_unit:
            return
        if current is not None:
            self._update(current, title, confidence)
            return
        own = confidence if confidence is not None else (0.82 if self.full_name else 0.68)
        slot = _Slot(len(self.slots), to_unit, title, day, confidence=own, previous=previous.number if previous else None)
        if previous is not None:
            previous.next = slot.number
        self.slots.append(slot)
        self.open.append(slot)

    @staticmethod
    def _update(slot: _Slot, title: str, confidence: float | None) -> None:
        slot.title = title or slot.title
        slot.confidence = max(slot.confidence, confidence if confidence is not None else 0.72)
        slot.events += 1


SLOT_SCHEMA = "party string, slot int, unit string, title string, active_from string, active_to string, confidence double, previous_slot int, next_slot int, events int"


def build_slots(events: DataFrame) -> DataFrame:
    """Slots of events (party, effective, event_id, from_unit, to_unit, title, full_name, confidence), all text but the last two.

    Events run in (effective or source date, event id) order per party; undated events come first and open slots without a
    start. A party whose events each leave the unit of the event before has at most one open slot, and its slots are the runs of
    one unit: these are windows and aggregates. Other parties go through the state machine, one ordered fold each.
    """
    key = F.coalesce("effective", F.lit(""))
    w = W.partitionBy("party").orderBy(key, "event_id")
    to, origin, before = F.coalesce("to_unit", F.lit("")), F.coalesce("from_unit", F.lit("")), F.lag(F.coalesce("to_unit", F.lit(""))).over(w)
    rows = events.withColumns({"__to": to, "__before": before, "__day": key})
    moves = F.col("__before").isNull() | ((origin == F.col("__before")) & ((F.col("__to") == F.col("__before")) | ~(F.col("__to").contains(F.col("__before")) | F.col("__before").contains(F.col("__to")))))
    rows = rows.withColumn("__chain", F.min(moves & (F.col("__to") != "")).over(W.partitionBy("party")))
    return _chained(rows.where("__chain"), w).unionByName(_folded(rows.where("not __chain").select(*events.columns)))


def _chained(rows: DataFrame, w: W) -> DataFrame:
    """Slots as runs of one unit."""
    start = F.col("__before").isNull() | (F.col("__before") != F.col("__to"))
    full = F.first("full_name").over(w)
    own = F.coalesce("confidence", F.when(start, F.when(full, 0.82).otherwise(0.68)).otherwise(0.72))
    runs = rows.withColumns({"slot": F.sum(start.cast("int")).over(w) - 1, "__own": own, "__order": F.row_number().over(w)}).groupBy("party", "slot").agg(
        F.min_by("__to", "__order").alias("unit"),
        F.max_by("title", F.when(F.coalesce("title", F.lit("")) != "", F.col("__order"))).alias("title"),
        F.min_by("__day", "__order").alias("active_from"),
        F.max("__own").alias("confidence"),
        F.count("*").cast("int").alias("events"),
    )
    after = F.lead("active_from").over(W.partitionBy("party").orderBy("slot"))
    day = F.try_to_date(F.substring(after, 1, 10), "yyyy-MM-dd")
    end = F.when(after.isNull() | (after == ""), "").otherwise(F.coalesce(F.date_format(F.date_sub(day, 1), "yyyy-MM-dd"), after))
    number = F.col("slot").cast("int")
    return runs.select(
        "party", number.alias("slot"), "unit", F.coalesce("title", F.lit("")).alias("title"), "active_from", end.alias("active_to"), "confidence", F.when(number > 0, number - 1).alias("previous_slot"), F.when(after.isNotNull(), number + 1).alias("next_slot"), "events"
    )


def _folded(events: DataFrame) -> DataFrame:
    """Slots by the state machine."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(k=rows.effective.fillna("")).sort_values(["k", "event_id"], kind="stable")
        state = SlotFold(bool(rows.full_name.iloc[0]))
        fields = [rows[c].fillna("").tolist() for c in ("effective", "from_unit", "to_unit", "title")]
        for day, origin, to, title, c in zip(*fields, rows.confidence.astype(float).tolist()):
            state.step(day, origin, to, title, None if c != c else c)
        party = rows.party.iloc[0]
        return pd.DataFrame([(party, s.number, s.unit, s.title, s.start, s.end, s.confidence, s.previous, s.next, s.events) for s in state.slots], columns=[c.split()[0] for c in SLOT_SCHEMA.split(", ")]).astype({"previous_slot": "Int32", "next_slot": "Int32"})

    return events.groupBy("party").applyInPandas(fold, SLOT_SCHEMA)


HOLD = 0.14


def transition_bonus(before: dict, now: dict, gap_days: int | None, same_year_distinct: bool) -> float:
    """Bonus between two states (dicts with slot, party, unit; slot None is no slot)."""
    if before["slot"] is None or now["slot"] is None:
        return 0.0
    same_slot, same_party = before["slot"] == now["slot"], before["party"] is not None and before["party"] == now["party"]
    overlap = bool(before["unit"] and now["unit"] and (before["unit"] in now["unit"] or now["unit"] in before["unit"]))
    if same_year_distinct:
        return -0.28 if same_slot or same_party else (0.0 if overlap else 0.04)
    if same_slot:
        return 0.12 if gap_days is None or gap_days <= 180 else (0.06 if gap_days <= 365 else 0.0)
    if same_party and (gap_days is None or gap_days <= 365):
        return 0.08
    return -0.04 if overlap and gap_days is not None and gap_days <= 60 else 0.0


def viterbi(steps: list[dict]) -> list[dict | None]:
    """Best state of each step; a step has date, unit, surname_only and states (slot, party, unit, score). None is no slot.

    Ties go to the first previous state and at the end to (total, own score), first state.
    """
    lanes: list[list[tuple[float, int]]] = []
    options: list[list[dict]] = []
    for n, step in enumerate(steps):
        states = list(step["states"])
        if step["surname_only"]:
            states.append({"slot": None, "party": None, "unit": "", "score": HOLD})
        elif not states:
            states.append({"slot": None, "party": None, "unit": "", "score": 0.0})
        lane = []
        for s in states:
            if n == 0:
                lane.append((s["score"], -1))
                continue
            before = steps[n - 1]
            gap = abs((step["date"] - before["date"]).days) if step["date"] and before["date"] else None
            apart = bool(step["date"] and before["date"] and step["date"].year == before["date"].year and step["unit"] and before["unit"] and step["unit"] not in before["unit"] and before["unit"] not in step["unit"] and (step["surname_only"] or before["surname_only"]))
            totals = [t + transition_bonus(p, s, gap, apart) for (t, _), p in zip(lanes[-1], options[-1])]
            at = max(range(len(totals)), key=lambda i: (totals[i], -i))
            lane.append((totals[at] + s["score"], at))
        lanes.append(lane)
        options.append(states)
    if not steps:
        return []
    at = max(range(len(lanes[-1])), key=lambda i: (lanes[-1][i][0], options[-1][i]["score"], -i))
    out: list[dict | None] = []
    for n in range(len(steps) - 1, -1, -1):
        out.append(options[n][at] if options[n][at]["slot"] is not None else None)
        at = lanes[n][at][1]
    return out[::-1]


TIMELINE_SCHEMA = "name string, mention_id long, slot_id long, score double"


def recommend_timeline(candidates: DataFrame, states: int = 5) -> DataFrame:
    """(name, mention_id, slot_id, score) along each name's timeline, for mentions whose best state is a slot.

    candidates: name, mention_id, observed (date), unit, surname_only, slot_id, party_id, slot_unit, score, active_from; one
    row per candidate, slot_id null for mentions without one.
    """

    score = F.when(~F.isnan("score"), F.col("score"))
    order = ["name", F.asc_nulls_last("observed"), F.asc_nulls_last("unit"), "mention_id", score.desc_nulls_last(), F.desc_nulls_last("active_from"), F.desc_nulls_last("slot_id")]
    fields = ["name", "mention_id", "observed", "unit", "surname_only", "slot_id", "party_id", "slot_unit", "score"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Names come whole and in order; a name's steps are held and nothing of the names before."""
        steps, name, found = [], None, []

        def close() -> None:
            found.extend((name, s["mention"], p["slot"], p["score"]) for s, p in zip(steps, viterbi(steps)) if p is not None)

        def give() -> pa.RecordBatch:
            columns = list(zip(*found)) if found else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.float64()))], ["name", "mention_id", "slot_id", "score"])

        for batch in batches:
            for own, mention, day, unit, surname, slot, party, slot_unit, s in zip(*[batch.column(c).to_pylist() for c in fields]):
                if steps and own != name:
                    close()
                    steps = []
                name = own
                if not steps or (steps[-1]["mention"], steps[-1]["date"], steps[-1]["__unit"]) != (mention, day, unit):
                    steps.append({"mention": mention, "date": day, "__unit": unit, "unit": unit or "", "surname_only": bool(surname), "states": []})
                if slot is not None and len(steps[-1]["states"]) < states:
                    steps[-1]["states"].append({"slot": slot, "party": party, "unit": slot_unit or "", "score": s})
            if found:
                yield give()
                found.clear()
        close()
        yield give()

    return candidates.repartition("name").sortWithinPartitions(*order).select(*fields).mapInArrow(fold, TIMELINE_SCHEMA)
