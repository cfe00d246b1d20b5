"""Commands a pipeline is made of."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from lettermill.operators.filters import MessageFilter, default_filter, resolve_mark_auto
from lettermill.operators.folders import FolderChoice
from lettermill.schema import BATCH_NUMBER, BATCH_SIZE, FETCH_NUMBER


@dataclass(frozen=True)
class TableTarget:
    """Deliver into an archive table below ``path``."""

    path: str
    host: str | None = None

    def __str__(self) -> str:
        return f"table {self.path}"


@dataclass(frozen=True)
class MaildirTarget:
    """Deliver into a Maildir all executors can reach."""

    path: str
    host: str | None = None

    def __str__(self) -> str:
        return f"maildir {self.path}"


@dataclass(frozen=True)
class CallTarget:
    """Deliver by a Python function ``fn(raw, msg_hash)``."""

    fn: Callable[[bytes, str], object]
    name: str = "function"

    def __str__(self) -> str:
        return self.name


Target = TableTarget | MaildirTarget | CallTarget


@dataclass(frozen=True)
class _Command:
    filter: MessageFilter = MessageFilter()
    folders: FolderChoice | None = None  # None: those of the pipeline
    dry_run: bool = False

    kind = ""
    needs_folders = False

    def effective_filter(self) -> MessageFilter:
        return default_filter(self.kind, self.filter, getattr(self, "how", None))

    def with_folders(self, common: FolderChoice | None) -> "_Command":
        chosen = self.folders if self.folders is not None else common
        if chosen is None:
            if self.needs_folders:
                raise ValueError(f"{self.kind} needs to be told its folders")
            chosen = FolderChoice()
        return replace(self, folders=chosen)

    def mark_name(self) -> str | None:
        return None


@dataclass(frozen=True)
class Count(_Command):
    kind = "count"


@dataclass(frozen=True)
class Mark(_Command):
    how: str = "seen"

    kind = "mark"
    needs_folders = True

    def mark_name(self) -> str:
        return self.how


@dataclass(frozen=True)
class Fetch(_Command):
    target: Target | None = None
    mark: str = "auto"
    mode: str = "careful"
    fetch_number: int = FETCH_NUMBER
    batch_number: int = BATCH_NUMBER
    batch_size: int = BATCH_SIZE
    hooks: tuple[str, ...] = field(default=())

    kind = "fetch"

    def mark_name(self) -> str:
        return resolve_mark_auto(self.effective_filter()) if self.mark == "auto" else self.mark


@dataclass(frozen=True)
class Delete(_Command):
    method: str = "auto"

    kind = "delete"
    needs_folders = True


Command = Count | Mark | Fetch | Delete


def prepare(
    commands: Sequence[Command | None], folders: FolderChoice | None = None
) -> list[Command]:
    """Drop empty commands, fill in folders, and refuse what cannot work."""
    ready = [c.with_folders(folders) for c in commands if c is not None]
    for command in ready:
        if isinstance(command, Fetch) and command.target is None:
            raise ValueError("no delivery target is given to fetch")
    return ready


def _place(choice: FolderChoice) -> str:
    names = ", ".join(map(repr, choice.include))
    text = f"in {names}" if names else "in all folders"
    if choice.exclude:
        text += " excluding " + ", ".join(map(repr, choice.exclude))
    return text


def describe(
    commands: Sequence[Command | None],
    accounts: Sequence[tuple[str, str, int]],
    now: dt.datetime | int,
    every: int | None = None,
    folders: FolderChoice | None = None,
) -> list[str]:
    """What a pipeline would do, in words; touches no mail.

    ``accounts`` are (user, host, port).
    """
    head = "for each of" if every is None else f"every {every} seconds, for each of"
    lines = [f"# {head}"]
    lines += [f"... user {user} on host {host} port {port} (SSL)" for user, host, port in accounts]
    lines.append("# do")
    for command in prepare(commands, folders):
        search = command.effective_filter().bind(now).render(repeating=every is not None)
        what = f"search {search}, perform {command.kind}"
        marked = command.mark_name()
        if marked is not None:
            what += f", mark them as {marked.upper()}"
        lines.append(f"... {_place(command.folders)}: {what}")
    return lines
