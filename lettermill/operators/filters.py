"""Message selection.

``MessageFilter`` is what a user writes; ``bind`` resolves its time cut-offs
against a clock and stamp files and gives a ``BoundFilter``, which is one
Catalyst predicate.
"""

from __future__ import annotations

import datetime as dt
import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_DAY_NS = 86_400 * 10**9
_EPOCH = dt.date(1970, 1, 1)


class _Unset:
    """Marks a flag filter nobody chose, so a command may put in its default."""

    def __repr__(self) -> str:
        return "UNSET"

    def __reduce__(self):
        return "UNSET"


UNSET = _Unset()
TriState = bool | None | _Unset


def to_ns(now: dt.datetime | int) -> int:
    """Nanoseconds since the epoch; a naive datetime is taken as UTC."""
    if isinstance(now, int):
        return now
    if now.tzinfo is None:
        now = now.replace(tzinfo=dt.timezone.utc)
    since = now - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    return (since.days * 86_400 + since.seconds) * 10**9 + since.microseconds * 1000


def utc_day(ns: int) -> dt.date:
    return _EPOCH + dt.timedelta(days=ns // _DAY_NS)


def _chosen(flag: TriState) -> bool | None:
    return None if isinstance(flag, _Unset) else flag


def _quoted(text: str) -> str:
    for special in ("\\", '"'):
        text = text.replace(special, "\\" + special)
    return f'"{text}"'


def _day_text(day: dt.date) -> str:
    return f"{day.day}-{day:%b}-{day.year}"


@dataclass(frozen=True)
class BoundFilter:
    """A filter whose cut-off days are known."""

    seen: bool | None = None
    flagged: bool | None = None
    from_contains: tuple[str, ...] = ()
    from_not_contains: tuple[str, ...] = ()
    before: dt.date | None = None
    not_before: dt.date | None = None

    def column(self) -> Column:
        sender = F.lower(F.coalesce(F.col("from_addr"), F.lit("")))
        day = F.col("internal_date").cast("date")
        terms: list[Column] = []
        for name, wanted in (("seen", self.seen), ("flagged", self.flagged)):
            if wanted is not None:
                terms.append(F.col(name) if wanted else ~F.col(name))
        terms += [F.contains(sender, F.lower(F.lit(s))) for s in self.from_contains]
        terms += [~F.contains(sender, F.lower(F.lit(s))) for s in self.from_not_contains]
        if self.before is not None:
            terms.append(day < F.lit(self.before))
        if self.not_before is not None:
            terms.append(~(day < F.lit(self.not_before)))
        return functools.reduce(operator.and_, terms) if terms else F.lit(True)

    @property
    def dynamic(self) -> bool:
        return self.before is not None or self.not_before is not None

    def render(self, repeating: bool = False) -> str:
        """The filter as search text, in a fixed order of terms."""
        words = [
            word
            for value, yes, no in (
                (self.seen, "SEEN", "UNSEEN"),
                (self.flagged, "FLAGGED", "UNFLAGGED"),
            )
            if value is not None
            for word in [yes if value else no]
        ]
        words += ["FROM " + _quoted(s) for s in self.from_contains]
        words += ["NOT FROM " + _quoted(s) for s in self.from_not_contains]
        if self.before is not None:
            words.append("BEFORE " + _day_text(self.before))
        if self.not_before is not None:
            words.append("NOT BEFORE " + _day_text(self.not_before))
        text = "(" + (" ".join(words) or "ALL") + ")"
        return text + " {dynamic}" if repeating and self.dynamic else text


@dataclass(frozen=True)
class MessageFilter:
    """Which messages a command works on; everything left out matches all."""

    seen: TriState = UNSET
    flagged: TriState = UNSET
    from_contains: tuple[str, ...] = ()
    from_not_contains: tuple[str, ...] = ()
    older_than_days: tuple[int, ...] = ()
    newer_than_days: tuple[int, ...] = ()
    older_than_timestamp_in: tuple[str, ...] = ()
    newer_than_timestamp_in: tuple[str, ...] = ()
    older_than_mtime_of: tuple[str, ...] = ()
    newer_than_mtime_of: tuple[str, ...] = ()

    def bind(self, now: dt.datetime | int, spark: SparkSession | None = None) -> BoundFilter:
        """Resolve the cut-offs: the earliest "older", the latest "newer"."""
        older = self._cutoffs(
            now, spark, self.older_than_days, self.older_than_timestamp_in, self.older_than_mtime_of
        )
        newer = self._cutoffs(
            now, spark, self.newer_than_days, self.newer_than_timestamp_in, self.newer_than_mtime_of
        )
        return BoundFilter(
            seen=_chosen(self.seen),
            flagged=_chosen(self.flagged),
            from_contains=tuple(self.from_contains),
            from_not_contains=tuple(self.from_not_contains),
            before=utc_day(min(older)) if older else None,
            not_before=utc_day(max(newer)) if newer else None,
        )

    def column(
        self, now: dt.datetime | int | None = None, spark: SparkSession | None = None
    ) -> Column:
        """The condition on message rows; ``now`` is needed when days are counted back from it."""
        if now is None and (self.older_than_days or self.newer_than_days):
            raise ValueError("a filter by age needs to know the present time")
        return self.bind(0 if now is None else now, spark).column()

    @staticmethod
    def _cutoffs(
        now: dt.datetime | int,
        spark: SparkSession | None,
        days: tuple[int, ...],
        stamp_files: tuple[str, ...],
        touched_files: tuple[str, ...],
    ) -> list[int]:
        from lettermill.sources.cutoffs import cutoff_from_mtime, cutoff_from_timestamp_file

        if (stamp_files or touched_files) and spark is None:
            spark = SparkSession.active()
        found = [to_ns(now) - d * _DAY_NS for d in days]
        found += [cutoff_from_timestamp_file(spark, path) for path in stamp_files]
        found += [cutoff_from_mtime(spark, path) for path in touched_files]
        return found


def default_filter(command: str, chosen: MessageFilter, mark: str | None = None) -> MessageFilter:
    """Put a command's default flag filters into a filter.

    count takes any message; fetch takes unseen and delete takes seen ones
    unless ``seen`` was chosen; mark takes the messages not yet marked that way
    when neither flag was chosen.
    """
    from dataclasses import replace

    if command == "fetch" and chosen.seen is UNSET:
        return replace(chosen, seen=False)
    if command == "delete" and chosen.seen is UNSET:
        return replace(chosen, seen=True)
    if command == "mark" and _chosen(chosen.seen) is None and _chosen(chosen.flagged) is None:
        flag, value = MARKS[mark]
        return replace(chosen, **{flag: not value})
    return chosen


# What each kind of marking sets (fixed values).
MARKS = {
    "seen": ("seen", True),
    "unseen": ("seen", False),
    "flagged": ("flagged", True),
    "unflagged": ("flagged", False),
}


def resolve_mark_auto(chosen: MessageFilter) -> str:
    """How fetched messages are marked when the user asks for ``auto``."""
    seen, flagged = _chosen(chosen.seen), _chosen(chosen.flagged)
    if seen is False and flagged is None:
        return "seen"
    if seen is None and flagged is False:
        return "flagged"
    return "noop"
