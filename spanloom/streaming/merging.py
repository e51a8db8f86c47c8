"""Merging of neighbouring cues on a stream, with a bounded reorder buffer per media."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .windows import LATE

#: Gaps in seconds that decide alone, and marks after which a cue goes on or ends.
JOIN, PART, SHORT = 0.12, 0.80, 0.30
OPEN_END, CLOSED_END = ",，;；", ".!?。！？"
HELD = 3
ROW = "media_id string, t0 double, t1 double, text string, speaker string"


def joins(a: dict, b: dict, similarity=None) -> bool:
    """Whether cue ``b`` continues cue ``a``; ``similarity(a, b)`` above 0.55 decides middling gaps where it is given, 0.5 stands in for it."""
    gap = b["t0"] - a["t1"]
    if gap < JOIN:
        return True
    known = {a["speaker"], b["speaker"]} - {None, "unknown"}
    if gap > PART or (len(known) == 2):
        return False
    end = (a["text"] or "").rstrip()[-1:]
    if end and end in OPEN_END + CLOSED_END:
        return end in OPEN_END
    if 0.15 <= gap <= 0.60:
        return (similarity(a["text"], b["text"]) if similarity else 0.5) > 0.55
    return gap < SHORT


def push(held: list[dict], cue: dict, similarity=None) -> list[dict]:
    """Add a cue to the buffer (changed in place) in time order; returns the cues that are decided."""
    held.append(cue)
    held.sort(key=lambda c: (c["t0"], c["t1"]))
    if len(held) < HELD:
        return []
    a, b = held[0], held[1]
    if joins(a, b, similarity):
        held[:2] = [{**a, "t1": b["t1"], "text": f"{a['text'] or ''} {b['text'] or ''}".strip()}]
        return []
    return [held.pop(0)]


def merge_stream(stream: DataFrame, late: str = LATE, similarity=None) -> DataFrame:
    """Cues (event_time, media_id, t0, t1, text, speaker) merged as they come; what a media still holds follows when the watermark passes it by ``late``.

    State per media is at most three cues.
    """

    def run(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = ["media_id", "t0", "t1", "text", "speaker"]
        if state.hasTimedOut:
            held = json.loads(state.get[0])
            state.remove()
            yield pd.DataFrame([{**c, "media_id": key[0]} for c in held], columns=names)
            return
        held = json.loads(state.get[0]) if state.exists else []
        rows = [r for pdf in batches for r in pdf.to_dict("records")]
        out, last = [], 0
        for r in sorted(rows, key=lambda r: (r["t0"], r["t1"])):
            last = max(last, int(r["event_time"].timestamp() * 1000))
            out += push(held, {c: (None if pd.isna(r[c]) else r[c]) for c in names[1:]}, similarity)
        state.update((json.dumps(held),))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame([{**c, "media_id": key[0]} for c in out], columns=names)

    return stream.withWatermark("event_time", late).groupBy("media_id").applyInPandasWithState(run, ROW, "held string", "append", GroupStateTimeout.EventTimeTimeout)
