"""A steppable digital twin of a theory, alone or for many scenarios at once."""

from __future__ import annotations

import re
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame

from strandline.operators.theory import Theory

_RULE = re.compile(r"^\s*(.+?)\s*(>=|<=|==|>|<)\s*([+-]?[\d.eE+-]+)\s*$")


def holds(rule: str, state: dict[str, float]) -> bool:
    """Is `variable operator number` true of the state? What can't be read is false."""
    m = _RULE.match(rule or "")
    if not m or m[1] not in state:
        return False
    try:
        x, y = state[m[1]], float(m[3])
    except ValueError:
        return False
    return {">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y, "==": x == y}[m[2]]


class DigitalTwin:
    def __init__(self, variables: list[str], equations: list[dict], states: list[dict], transitions: list[dict], start: str | None = None):
        self.variables, self.equations, self.states, self.transitions = variables, equations, states, transitions
        top = max(states, key=lambda s: s["prevalence"])["name"] if states else None
        self.first = start or top
        depth = max([0, *(lag for e in equations for lag in e.get("lags", []))]) + 1
        self.history: dict[str, deque] = {v: deque(maxlen=depth) for v in variables}
        self.state: dict[str, float] = {}
        self.reset()

    @classmethod
    def of(cls, t: Theory) -> DigitalTwin:
        return cls(t.variables, t.equations, t.states, t.transitions)

    def reset(self, values: dict[str, float] | None = None) -> None:
        self.mode = self.first
        centre = next((s["centroid"] for s in self.states if s["name"] == self.mode), {})
        self.state = {v: float((values or {}).get(v, centre.get(v, 0.0))) for v in self.variables}
        for h in self.history.values():
            h.clear()

    def past(self, variable: str, lag: int) -> float:
        h = self.history[variable]
        return h[-1 - lag] if lag < len(h) else h[0] if h else self.state[variable]

    def step(self, inputs: dict[str, float]) -> dict[str, float]:
        """Inputs, then equations over the history, then the likeliest transition whose trigger holds."""
        self.state |= {k: float(v) for k, v in inputs.items() if k in self.state}
        for v in self.variables:
            self.history[v].append(self.state[v])
        new = {}
        for e in self.equations:
            if e["target"] in self.state and e["target"] not in inputs and all(a in self.history for a in e["sources"]):
                x = [self.past(a, lag) for a, lag in zip(e["sources"], e.get("lags", [0] * len(e["sources"])), strict=True)]
                new[e["target"]] = e["intercept"] + (e["coef"][0] * x[0] + e["coef"][1] * x[0] ** 2 if e["kind"] == "quadratic" else sum(c * v for c, v in zip(e["coef"], x, strict=True)))
        self.state |= new
        fired = [t for t in self.transitions if t["from_state"] == self.mode and holds(t["trigger"], self.state)]
        if fired:
            self.mode = max(fired, key=lambda t: t["probability"])["to_state"]
        return dict(self.state)


def rollout(inputs: DataFrame, twin: DigitalTwin, scenario: str = "scenario", step: str = "step") -> DataFrame:
    """State and mode after every step of every scenario: (scenario, step, mode, variables...). inputs: scenario, step and
    columns named as variables; a null is no input. A scenario is one group."""
    given = [c for c in inputs.columns if c in twin.variables]
    names = twin.variables

    def run(t: pd.DataFrame) -> pd.DataFrame:
        twin.reset()
        rows = []
        for r in t.sort_values(step).to_dict("records"):
            s = twin.step({c: r[c] for c in given if pd.notna(r[c])})
            rows.append((r[scenario], r[step], twin.mode, *[s[v] for v in names]))
        return pd.DataFrame(rows, columns=[scenario, step, "mode", *names])

    kinds = {f.name: f.dataType.simpleString() for f in inputs.schema}
    return inputs.groupBy(scenario).applyInPandas(run, f"{scenario} {kinds[scenario]}, {step} {kinds[step]}, mode string, " + ", ".join(f"`{v}` double" for v in names))
