"""State machines for speech, meetings and languages; see :mod:`skein.streaming.fold`."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class VoiceSessions:
    """Speech windows to utterances. Rows: ``t`` (ms), ``p`` (probability) and, if there is one, ``level`` (loudness).

    A session opens after ``needs`` windows in a row above ``enter``, with what lies up to ``pre`` before
    the first, and windows above ``leave`` prolong it. After ``tail`` ms without one it closes, ``pad`` after the
    last voiced window, once it is ``least`` ms long; until then it keeps the silence that comes, and a
    window needs ``enter`` again. A session of ``most`` ms is cut, and the rest goes on as the next one: in the
    middle of the longest pause of ``pause`` ms in the last ``search`` ms (the latest of equal ones), where
    nothing is split; else in the middle of the quietest such stretch, if that is below ``quiet`` of the
    voice's level; else at its end. The two latter are flagged, and the rest starts ``overlap`` ms earlier.
    Each session begins with its own audio: what a close leaves over is the next one's look-behind. A jump of the
    clock over ``jump`` closes what is open and forgets the rest. State is bounded by ``most``.
    """

    window: int = 32
    enter: float = 0.38
    leave: float = 0.22
    needs: int = 3
    pre: int = 320
    pad: int = 288
    tail: int = 400
    least: int = 1_100
    most: int = 24_000
    jump: int = 1_000
    search: int = 3_000
    pause: int = 128
    overlap: int = 736
    quiet: float = 0.15
    output: str = "t_start_ms long, t_end_ms long, voiced_ms long, truncated boolean"

    def start(self) -> dict[str, Any]:
        """``held``: [t, voiced, level] of each window of what is open, or of the look-behind."""
        return {"open": False, "held": [], "run": 0, "silent": 0, "seen": None}

    def _look_behind(self, s: dict, left: list) -> None:
        since = left[-1][0] + self.window - self.pre if left else 0
        s.update(open=False, held=[[t, False, level] for t, _, level in left if t >= since], run=0, silent=0)

    def _session(self, held: list, truncated: bool) -> list[tuple]:
        voiced = sum(self.window for _, v, _ in held if v)
        return [(held[0][0], held[-1][0] + self.window, voiced, truncated)] if held else []

    def _close(self, s: dict) -> list[tuple]:
        held, last = s["held"], max(i for i, x in enumerate(s["held"]) if x[1])
        end = max(held[last][0] + self.window + self.pad, held[0][0] + self.least)
        kept = [x for x in held if x[0] < end]
        self._look_behind(s, held[len(kept) :])
        return self._session(kept, False)

    def _cut(self, s: dict) -> list[tuple]:
        held = s["held"]
        at, split = self._seam(held)
        rest = held[max(0, at - self.overlap // self.window) if split else at :]
        if any(v for _, v, _ in rest):
            s.update(held=rest, silent=next(i for i, x in enumerate(reversed(rest)) if x[1]) * self.window)
        else:
            self._look_behind(s, rest)
        return self._session(held[:at], split)

    def _seam(self, held: list) -> tuple[int, bool]:
        """The window before which a cut falls, and whether it splits speech."""
        start, need = max(0, len(held) - self.search // self.window), -(-self.pause // self.window)
        best, run = None, 0
        for i in range(start, len(held) + 1):
            if i < len(held) and not held[i][1]:
                run += 1
                continue
            if run >= need and (best is None or run >= best[0]):
                best = (run, i - run)
            run = 0
        if best:
            return max(1, best[1] + best[0] // 2), False
        levels = [x[2] for x in held]
        if None not in levels and len(held) >= need:
            last = max(i for i, x in enumerate(held) if x[1])
            loud = lambda part: (sum(x * x for x in part) / len(part)) ** 0.5
            level, at = min((loud(levels[i : i + need]), i) for i in range(start, len(held) - need + 1))
            if level < loud(levels[: last + 1]) * self.quiet:
                return max(1, at + need // 2), True
        return len(held), True

    def step(self, s: dict, row: dict) -> tuple[dict, list[tuple]]:
        t, p, made = int(row["t"]), float(row["p"]), []
        level = row.get("level")
        level = None if level is None or level != level else float(level)
        if s["seen"] is not None and t - s["seen"] > self.jump:
            made = self.finish(s)
            s = self.start()
        s["seen"] = t
        speaking = s["open"] and s["silent"] < self.tail
        voiced = p >= (self.leave if speaking else self.enter)
        s["held"].append([t, voiced, level])
        if not s["open"]:
            s["run"] = s["run"] + 1 if voiced else 0
            first, since = len(s["held"]) - s["run"], t + self.window * (1 - self.needs) - self.pre
            s["held"] = [[x, i >= first, y] for i, (x, _, y) in enumerate(s["held"]) if i >= first or x >= since]
            if s["run"] >= self.needs:
                s.update(open=True, run=0, silent=0)
            return s, made
        s["silent"] = 0 if voiced else s["silent"] + self.window
        length = t + self.window - s["held"][0][0]
        if length >= self.most:
            made += self._cut(s)
        elif s["silent"] >= self.tail and length >= self.least:
            made += self._close(s)
        return s, made

    def finish(self, s: dict) -> list[tuple]:
        return self._close(s) if s["open"] else []


@dataclass(frozen=True)
class OpenSpeech:
    """Looks at what is open, each ``every`` ms while speech is: its start (the same while it stays open), and the last ``longest`` ms of it.

    The look leaves the session open. Rows as for ``sessions``.
    """

    sessions: VoiceSessions = VoiceSessions()
    every: int = 1_000
    longest: int = 12_000
    output: str = "t_start_ms long, from_ms long, to_ms long, voiced_ms long"

    def start(self) -> dict[str, Any]:
        return {"of": self.sessions.start(), "next": None}

    def step(self, s: dict, row: dict) -> tuple[dict, list[tuple]]:
        s["of"], _ = self.sessions.step(s["of"], row)
        if not s["of"]["open"]:
            s["next"] = None
            return s, []
        held, now = s["of"]["held"], int(row["t"]) + self.sessions.window
        if s["next"] is not None and now < s["next"]:
            return s, []
        s["next"] = now + self.every
        tail = held[max(0, len(held) - self.longest // self.sessions.window) :]
        return s, [(held[0][0], tail[0][0], now, sum(self.sessions.window for _, v, _ in held if v))]

    def finish(self, s: dict) -> list[tuple]:
        return []


@dataclass(frozen=True)
class LoudnessGate:
    """Loudness to speech. Rows: ``t``, ``level``. The room's floor follows the quiet slowly and leaves out what counts as speech."""

    first: float = 0.0015
    enter: float = 4.0
    leave: float = 2.5
    pace: float = 0.05
    output: str = "t long, level double, floor double, active boolean"

    def start(self) -> dict[str, Any]:
        return {"floor": self.first, "active": False}

    def step(self, s: dict, row: dict) -> tuple[dict, list[tuple]]:
        level = float(row["level"])
        s["active"] = level > max(s["floor"] * self.leave, 0.005) if s["active"] else level > max(s["floor"] * self.enter, 0.01)
        if not s["active"]:
            s["floor"] = min(max(s["floor"] * (1 - self.pace) + level * self.pace, 1e-5), 0.05)
        return s, [(int(row["t"]), level, s["floor"], s["active"])]

    def finish(self, s: dict) -> list[tuple]:
        return []


@dataclass(frozen=True)
class Detection:
    """Loudness to utterances at once: the gate's word on each window is the sessions' probability. Rows: ``t``, ``level``."""

    gate: LoudnessGate = LoudnessGate()
    sessions: VoiceSessions = VoiceSessions()

    @property
    def output(self) -> str:
        return self.sessions.output

    def start(self) -> dict[str, Any]:
        return {"gate": self.gate.start(), "of": self.sessions.start()}

    def step(self, s: dict, row: dict) -> tuple[dict, list[tuple]]:
        seen = s["of"]["seen"]
        if seen is not None and int(row["t"]) - seen > self.sessions.jump:
            s["gate"]["active"] = False  # the floor stays the room's
        s["gate"], made = self.gate.step(s["gate"], row)
        s["of"], out = self.sessions.step(s["of"], {"t": row["t"], "p": float(made[0][3]), "level": row["level"]})
        return s, out

    def finish(self, s: dict) -> list[tuple]:
        return self.sessions.finish(s["of"])


@dataclass(frozen=True)
class MeetingDetector:
    """Polls to meeting starts and ends. Rows: ``t``, ``app``, ``browser``, ``mic`` (booleans).

    A start takes 2 polls of app and mic, or 6 of browser and mic; never mic or app alone. While an
    app runs, up to ``quiet`` polls without mic pass; ``absent`` polls without app and browser end it.
    """

    app_polls: int = 2
    browser_polls: int = 6
    quiet: int = 6
    absent: int = 24
    output: str = "t long, change string, episode long"

    def start(self) -> dict[str, int | bool]:
        return {"app": 0, "browser": 0, "quiet": 0, "absent": 0, "on": False, "episode": 0}

    def step(self, s: dict, row: dict) -> tuple[dict, list[tuple]]:
        app, browser, mic = bool(row["app"]), bool(row["browser"]), bool(row["mic"])
        s["app"] = s["app"] + 1 if app and mic else 0
        s["browser"] = s["browser"] + 1 if browser and mic else 0
        if not s["on"]:
            if s["app"] >= self.app_polls or s["browser"] >= self.browser_polls:
                s.update(on=True, quiet=0, absent=0, episode=s["episode"] + 1)
                return s, [(int(row["t"]), "start", s["episode"])]
            return s, []
        s["quiet"] = s["quiet"] + 1 if app and not mic else 0
        s["absent"] = s["absent"] + 1 if not app and not (browser and mic) else 0
        if s["quiet"] > self.quiet or s["absent"] >= self.absent:
            s.update(on=False, app=0, browser=0)
            return s, [(int(row["t"]), "end", s["episode"])]
        return s, []

    def finish(self, s: dict) -> list[tuple]:
        return []


@dataclass(frozen=True)
class LanguageVote:
    """Readings to a settled language. Rows: ``t``, ``language``, ``confidence``, ``speech_ms``.

    A reading weighs confidence times speech. The vote settles at 8 s and two stretches with 60 in 100
    for one language, or at 30 s regardless; it flips if over the last six stretches a challenger has
    twice everything else, 3 s, two stretches and a mean confidence of 0.5. Ties go by the alphabet.
    """

    settle_ms: int = 8_000
    settle_any_ms: int = 30_000
    share: float = 0.6
    last: int = 6
    output: str = "t long, language string, speech_ms long"

    def start(self) -> dict[str, Any]:
        return {"settled": None, "weights": {}, "stretches": 0, "ms": 0, "recent": []}

    def step(self, s: dict, row: dict) -> tuple[dict, list[tuple]]:
        language = row["language"]
        if not isinstance(language, str) or language in ("", "auto"):
            return s, []
        ms, confidence = int(row["speech_ms"]), float(row["confidence"])
        s["weights"][language] = s["weights"].get(language, 0.0) + confidence * ms
        s["stretches"], s["ms"] = s["stretches"] + 1, s["ms"] + ms
        s["recent"] = [*s["recent"], [language, confidence, ms]][-self.last :]
        if s["settled"] is None:
            best = min(s["weights"], key=lambda x: (-s["weights"][x], x))
            part = s["weights"][best] / (sum(s["weights"].values()) or 1)
            if s["ms"] >= self.settle_any_ms or (s["ms"] >= self.settle_ms and s["stretches"] >= 2 and part >= self.share):
                s["settled"] = best
                return s, [(int(row["t"]), best, s["ms"])]
            return s, []
        for other in sorted({x for x, *_ in s["recent"]} - {s["settled"]}):
            own = [(c, m) for x, c, m in s["recent"] if x == other]
            rest = sum(c * m for x, c, m in s["recent"] if x != other)
            if len(own) >= 2 and sum(m for _, m in own) >= 3_000 and sum(c for c, _ in own) / len(own) >= 0.5 and sum(c * m for c, m in own) >= 2 * rest:
                s["settled"] = other
                return s, [(int(row["t"]), other, s["ms"])]
        return s, []

    def finish(self, s: dict) -> list[tuple]:
        return []


@dataclass(frozen=True)
class AdaptiveLag:
    """Measured delays to the delay in use: the median of the last five within two minutes, from two on. Rows: ``t``, ``lag_ms``, ``reset``."""

    keep: int = 5
    within: int = 120_000
    needs: int = 2
    output: str = "t long, lag_ms long, warm boolean"

    def start(self) -> list:
        return []

    def step(self, s: list, row: dict) -> tuple[list, list[tuple]]:
        t = int(row["t"])
        s = [] if row.get("reset") else [x for x in s if t - x[0] <= self.within]
        if row["lag_ms"] is not None and row["lag_ms"] == row["lag_ms"]:
            s = [*s, [t, int(row["lag_ms"])]][-self.keep :]
        ordered = sorted(x for _, x in s)
        warm, n = len(ordered) >= self.needs, len(ordered)
        middle = int((ordered[(n - 1) // 2] + ordered[n // 2]) / 2) if warm else 0
        return s, [(t, middle, warm)]

    def finish(self, s: list) -> list[tuple]:
        return []
