"""An operator beside the tracker: objects circled by hand, wrong objects captured, and the crops that a judge will want.

It is the tracker with more state: the circle that is looked at (and the one before it), how long a request may wait, until when a
capture is busy, and a map of crops by track and frame, which lose their place as soon as better ones or the track's end push them out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle, TimerValues

from .tracker import TRACK, TrackParams, Tracking, advance, keyed_state

#: How long a request waits for an object in its circle (fixed value), and how much wider than an object its own circle is.
WAIT_MS, AROUND = 1500, 1.8
COLUMNS = ["t_ms", "x", "y", "area", "sharp", "border", "sanity", "crop", "stroke", "radius"]
EVENTS = "stream long, t_ms long, track int, event string, stroke long, frames array<long>, crops array<binary>"
AREA = "x double, y double, radius double"


class Session(Tracking):
    def __init__(self, params: TrackParams, capture_ms: int | None):
        super().__init__(params, False, None)
        self.capture_ms = capture_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scene = handle.getValueState("scene", "next_id long, last long")
        self.tracks = handle.getMapState("tracks", "id long", TRACK)
        self.crops = handle.getMapState("crops", "track long, t_ms long", "quality double")
        self.snaps = handle.getMapState("snaps", "track long, t_ms long", "crop binary")
        self.zone = handle.getValueState("zone", AREA)
        self.asked = handle.getValueState("asked", f"stroke long, deadline long, had boolean, {AREA}")
        self.busy = handle.getValueState("busy", "until long")

    def _circled(self, t: int, rows: list[dict], out: list[tuple], stream: int) -> None:
        """A new request replaces the circle and remembers the one before; a request that still waits fails."""
        for r in rows:
            if self.asked.exists():
                out.append((stream, t, 0, "CIRCLE_REPLACED", self.asked.get()[0], None, None))
            before = self.asked.get()[2:] if self.asked.exists() else (True, *self.zone.get()) if self.zone.exists() else (False, None, None, None)
            self.asked.update((int(r["stroke"]), t + WAIT_MS, *before))
            self.zone.update((r["x"], r["y"], r["radius"]))

    def _picked(self, found: list[dict]) -> list[dict]:
        """All of found, or the largest one inside the circle alone."""
        if not self.zone.exists():
            return found
        x, y, radius = self.zone.get()
        inside = [f for f in found if math.hypot(f["x"] - x, f["y"] - y) <= radius]
        return [max(inside, key=lambda f: f["area"])] if inside else []

    def _answered(self, t: int, scene, found: list[dict], events: list[tuple], out: list[tuple], stream: int) -> None:
        """A circled object that is tracked is judged on this frame, if nothing has just triggered for it. Past the deadline the request
        fails and the circle before it comes back."""
        if not self.asked.exists():
            return
        stroke, deadline, had, *before = self.asked.get()
        track = next((tr for tr in scene.tracks if found and tr.missed == 0 and (tr.x, tr.y, tr.t) == (found[0]["x"], found[0]["y"], t)), None)
        if track is not None:
            self.zone.update((track.x, track.y, AROUND / 2 * math.sqrt(track.area)))
            self.asked.clear()
            out.append((stream, t, track.id, "CIRCLE_OK", stroke, None, None))
            if all(e[0] != track.id or e[1] not in ("LINE", "STEADY") for e in events) and not track.judged:
                track.judged, track.crops = True, []
                events.append((track.id, "OPERATOR", t, [t]))
        elif t > deadline:
            if had:
                self.zone.update(tuple(before))
            else:
                self.zone.clear()
            self.asked.clear()
            out.append((stream, t, 0, "CIRCLE_FAILED", stroke, None, None))

    def _told(self, t: int, events: list[tuple], now: dict, stream: int) -> list[tuple]:
        """Events with the crops of their frames; with capture, of steady objects one at a time, and only sane ones."""
        out = []
        for track, event, _, frames in events:
            crops = [now[track]["crop"] if u == t and track in now else self.snaps.getValue((track, u))[0] if self.snaps.containsKey((track, u)) else None for u in frames]
            if self.capture_ms is not None and event == "STEADY":
                if self.busy.exists() and t < self.busy.get()[0]:
                    event, frames, crops = "BUSY", [], []
                elif now[track]["sanity"] != "OK":
                    event, frames, crops = f"REFUSED:{now[track]['sanity']}", [], []
                else:
                    event, frames, crops = "CAPTURED", frames[:1], crops[:1]
                    self.busy.update((t + self.capture_ms,))
            out.append((stream, t, track, event, None, frames or None, crops or None))
        return out

    def _snapped(self, before: dict, scene, now: dict, t: int) -> None:
        live = {tr.id: {u for _, u in tr.crops} for tr in scene.tracks}
        for tr in scene.tracks:
            if t in live[tr.id] and tr.id in now:
                self.snaps.updateValue((tr.id, t), (now[tr.id]["crop"],))
        for track, frames in before.items():
            for u in frames - live.get(track, set()):
                self.snaps.removeKey((track, u))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        stream, scene, out = int(key[0]), self._loaded(), []
        kept = {tr.id: self._of(tr) for tr in scene.tracks}
        batch = pd.concat([r[COLUMNS] for r in rows])
        for t, frame in batch.sort_values(["t_ms", "x", "y"], kind="stable").groupby("t_ms", sort=True):
            t = int(t)
            if scene.last is not None and t < scene.last:
                out.append((stream, t, 0, "LATE", None, None, None))
                continue
            self._circled(t, frame.dropna(subset=["stroke"]).to_dict("records"), out, stream)
            found = self._picked(frame[frame["stroke"].isna()].dropna(subset=["x"]).to_dict("records"))
            before = {tr.id: {u for _, u in tr.crops} for tr in scene.tracks}
            events = advance(scene, t, found, self.params)
            now = {tr.id: f for tr in scene.tracks if tr.missed == 0 for f in found if (tr.x, tr.y, tr.t) == (f["x"], f["y"], t)}
            self._answered(t, scene, found, events, out, stream)
            out += self._told(t, events, now, stream)
            self._snapped(before, scene, now, t)
        self._kept(kept, scene)
        yield pd.DataFrame(out, columns=["stream", "t_ms", "track", "event", "stroke", "frames", "crops"]).astype({"stroke": "Int64"})


def operated(rows: DataFrame, params: TrackParams = TrackParams(), capture_ms: int | None = None) -> DataFrame:
    """Events of a streaming DataFrame of detections (stream, t_ms, x, y, area, sharp, border, sanity, crop) and requests (stream, t_ms,
    stroke, x, y, radius: a circle drawn by hand); columns that one has and the other hasn't are null.

    While a circle holds, the largest object in it is the only one that is tracked. A request is answered with CIRCLE_OK, and OPERATOR if
    nothing else judges the object in that frame; after WAIT_MS without an object with CIRCLE_FAILED, and the circle before it is back.
    Events that judge (LINE, STEADY, OPERATOR) bring the crops of their frames. With capture_ms the session collects wrong objects: each
    one that is held still is CAPTURED with one crop, BUSY if the one before takes capture_ms yet, or REFUSED with what its sanity says.
    """
    if capture_ms is not None:
        params = TrackParams(**{**params.__dict__, "line_on": False, "steady_on": True})
    shaped = rows.select(F.col("stream").cast("long"), F.col("t_ms").cast("long"), *(F.col(c).cast("double") for c in ("x", "y", "area", "sharp")), F.col("border").cast("boolean"), F.col("sanity").cast("string"), F.col("crop").cast("binary"), F.col("stroke").cast("long"), F.col("radius").cast("double"))
    keyed_state(rows.sparkSession)
    return shaped.groupBy("stream").transformWithStateInPandas(Session(params, capture_ms), EVENTS, "Append", "None")
