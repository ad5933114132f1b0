"""Report parameters.

``REFERENCE`` holds the values the original report pack hard-codes; ``FIXTURE``
the values that make sense on the test tables (January and February 2024, weeks 1-9), as
listed in FIXTURES.md section 3.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Params:
    # first day of the period in which the dialer runs as intended (D01, included)
    cut: str = "2018-03-12"
    # segments that form the control group
    control_segments: tuple = ("Z",)
    # Cases with more attempts than this
    extreme_attempts: int = 15
    # Weeks strictly above this, and these segments only
    week_floor: int = 5
    segments: tuple = ("A", "C", "E", "I", "Z")
    # wide tables: the week / hour values that become columns; None = the values
    # present in the data, as the original's spread does (the schema then follows
    # the data); a tuple fixes the schema
    week_columns: tuple | None = None
    hour_columns: tuple | None = None
    # P17, P18 (one case each) and P19 (several): case ids to show; None = every case
    case_id: tuple | None = (2501992,)
    shared_case_id: tuple | None = (2220557,)
    case_ids: tuple | None = (2268684, 2220557, 2501992)
    # Attempt caps (strictly below)
    attempt_cap: int = 16
    sequence_cap: int = 11
    sequence_segment: str = "Z"
    # Thresholds applied to rounded shares
    contact_share_min: float = 0.05
    sequence_share_min: float = 0.01
    # Hours left out of the line chart (compared as text)
    hours_left_out: tuple = ("8", "9", "21")
    # Week cap compared as TEXT against the week number as text
    week_cap_text: str = "20"
    # Months compared
    months: tuple = (2, 3, 4)
    # first-k reports (P20-P22, P26, P41): True numbers the first attempts afresh
    # (map-side top-k per case); False filters an attempt_no column that is
    # already materialised, e.g. on the stored attempts table
    renumber_first_attempts: bool = True
    def with_(self, **kw) -> "Params":
        return replace(self, **kw)

    def with_text(self, assignments) -> "Params":
        """Overrides from ``name=value`` texts, typed by the current value:
        ``cut=2018-03-12``, ``months=2,3,4``, ``case_ids=none``, ``attempt_cap=10``."""
        kinds = {f.name: getattr(self, f.name) for f in fields(self)}
        changes = {}
        for a in assignments:
            name, _, text = a.partition("=")
            if name not in kinds:
                raise KeyError(f"unknown parameter {name!r}")
            changes[name] = _parse(text, kinds[name], name)
        return replace(self, **changes)


_INT_TUPLES = {"week_columns", "hour_columns", "months", "case_id", "shared_case_id", "case_ids"}


def _parse(text: str, current, name: str):
    if text.lower() in ("none", "null"):
        return None
    if isinstance(current, bool):
        return text.lower() in ("1", "true", "yes")
    if isinstance(current, tuple) or name in _INT_TUPLES:
        items = [t.strip() for t in text.split(",") if t.strip()]
        return tuple(int(t) for t in items) if name in _INT_TUPLES else tuple(items)
    if isinstance(current, int):
        return int(text)
    if isinstance(current, float):
        return float(text)
    return text


REFERENCE = Params()

FIXTURE = Params(
    cut="2024-01-11",
    week_floor=1,
    week_columns=tuple(range(1, 10)),
    hour_columns=tuple(range(0, 24)),
    months=(1, 2, 3),
    case_id=(4,),
    shared_case_id=(8,),
    case_ids=(0, 4, 8),
    sequence_cap=4,
    week_cap_text="5",
)
