"""Silence canary as an event-time timer (I9), on the ordered state of ``ordered``.

A subscriber's value keeps the last reply, the first send, the sends since then that no verdict
has answered, and when the alert fired. Events count in the order of their own time, however they
arrive: the first send is the earliest one, a verdict that arrives before its send waits for it, and a reply
starts a new stretch from its own time on. An alert fires at the first moment at which the rule of E7 holds:
``silence_days`` after the stretch began and ``silence_ideas`` sends in it, and again each ``silence_days`` after.
The timer stands at that moment, so a subscriber who went quiet is noticed though nothing arrives.
Events of a moment come before an alert of the same moment; the clock is the watermark.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame

from ..operators.feedback import SILENCE_DAYS, SILENCE_IDEAS
from .ordered import Fold, stream_ordered

DAY = 86400


class SilenceFold(Fold):
    columns = ["kind", "idea_id", "domain"]
    out = "now_utc long, n_unanswered long, quiet_days long, breakdown string"
    shows = False

    def __init__(self, days: int = SILENCE_DAYS, ideas: int = SILENCE_IDEAS, day: int = DAY):
        self.ideas, self.day, self.quiet = ideas, day, days * day

    def start(self):
        return {"last": None, "first": None, "fired": None, "open": []}        # open: [ts, idea, domain] in order

    def step(self, state, ts, event):
        kind, idea, domain = event
        if kind == "send":
            state["first"] = ts if state["first"] is None else state["first"]
            state["open"].append([ts, idea, domain])
        elif kind == "verdict":
            state["open"] = [x for x in state["open"] if x[1] != idea]
        elif kind == "reply":
            state["last"] = ts
            state["open"] = [x for x in state["open"] if x[0] >= ts]

    def due(self, state):
        since = state["first"] if state["last"] is None else state["last"]
        if since is None or len(state["open"]) < self.ideas:
            return None
        at = max(since + self.quiet, state["open"][self.ideas - 1][0])
        fired = state["fired"]
        if fired is not None and (state["last"] is None or fired > state["last"]):
            at = max(at, fired + self.quiet)
        return at

    def idle(self, state, until):
        out = []
        while (at := self.due(state)) is not None and at < until:
            since = state["first"] if state["last"] is None else state["last"]
            # ideas without a domain take their place among the three and are not shown
            count = Counter(d or "" for _, _, d in state["open"])
            top = sorted(count.items(), key=lambda x: (-x[1], x[0]))[:3]
            out.append({"now_utc": at, "n_unanswered": len(state["open"]), "quiet_days": (at - since) // self.day,
                        "breakdown": ", ".join(f"{d} x{n}" for d, n in top if d)})
            state["fired"] = at
        return out


def stream_silence_canary(events: DataFrame, delay: str = "3 days") -> DataFrame:
    """``events(subscriber_id, kind, idea_id, domain, ts, seq)`` with kind in send / reply / verdict (a verdict
    answers ``idea_id``). One row for each time the canary fires for a subscriber."""
    return stream_ordered(events, ["subscriber_id"], SilenceFold(), delay)
