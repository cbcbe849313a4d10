"""Parameters shared by the claim operators."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace


def _as_date(value: dt.date | str) -> dt.date:
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


@dataclass(frozen=True)
class Params:
    """Date window, payer scope and branch switches of one run.

    ``fund`` is a fund code such as ``FDH`` or ``OFC``; ``None`` lets each
    operator use its own default.  ``payers`` and ``groups`` are the lists a
    user ticks on a screen.
    """

    date_from: dt.date
    date_to: dt.date
    fund: str | None = None
    payers: tuple[str, ...] | None = None
    groups: tuple[str, ...] | None = None
    include_opd: bool = True
    include_ipd: bool = True

    def __post_init__(self) -> None:
        object.__setattr__(self, "date_from", _as_date(self.date_from))
        object.__setattr__(self, "date_to", _as_date(self.date_to))
        for name in ("payers", "groups"):
            value = getattr(self, name)
            if value is not None:
                object.__setattr__(self, name, tuple(value))
        if self.date_from > self.date_to:
            raise ValueError("date_from is after date_to")

    def but(self, **changes) -> "Params":
        return replace(self, **changes)

    @property
    def branches(self) -> tuple[bool, bool]:
        """(outpatient, inpatient); ticking neither means both."""
        if not self.include_opd and not self.include_ipd:
            return True, True
        return self.include_opd, self.include_ipd
