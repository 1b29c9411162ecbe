"""Chaining operators into one lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial

from cellwave.model import Signal

Step = Callable[[Signal], Signal]


def step(fn: Callable[..., Signal], **params) -> Step:
    """Bind parameters; the step records itself in the sample provenance."""

    def run(sig: Signal) -> Signal:
        before = set(sig.axes)
        out = partial(fn, **params)(sig)
        after = set(out.axes)
        return out.recorded(
            getattr(fn, "__name__", "step"), params, sorted(before - after), sorted(after - before)
        )

    run.__name__ = getattr(fn, "__name__", "step")
    return run


def compose(*steps: Step) -> Step:
    """Apply steps in order."""

    def run(sig: Signal) -> Signal:
        for s in steps:
            sig = s(sig)
        return sig

    return run


def keyed(fn: Step, keys: Sequence[str], output_keys: Sequence[str] | None = None):
    """Apply one step to several named signals of a payload."""
    outputs = list(keys) if output_keys is None else list(output_keys)
    if len(outputs) != len(keys):
        raise ValueError("output_keys must match keys")

    def run(payload: Mapping[str, Signal]) -> dict[str, Signal]:
        missing = [k for k in keys if k not in payload]
        if missing:
            raise KeyError(f"payload lacks {missing}; it has {sorted(payload)}")
        return {**payload, **{o: fn(payload[k]) for k, o in zip(keys, outputs)}}

    return run
