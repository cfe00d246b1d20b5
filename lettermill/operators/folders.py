"""Folder lists and folder selection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.schema import NOSELECT


def list_folders(folders: DataFrame) -> DataFrame:
    """Folders that can be opened, in server order."""
    return folders.filter(~F.array_contains("attributes", NOSELECT)).orderBy(
        "account_idx", "folder_idx"
    )


@dataclass(frozen=True)
class FolderChoice:
    """Which folders a command visits, and in which order.

    A non-empty ``include`` replaces "all folders"; ``exclude`` always applies.
    """

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()

    def column(self, name: str = "folder") -> Column:
        """Predicate on message rows; reaches the scan as a folder filter."""
        wanted = F.col(name).isin(list(self.include)) if self.include else F.lit(True)
        return wanted & ~F.col(name).isin(list(self.exclude)) if self.exclude else wanted

    def select(self, folders: DataFrame) -> DataFrame:
        """Visited folders with ``folder_idx`` as the visiting order."""
        usable = folders.filter(~F.array_contains("attributes", NOSELECT)).filter(self.column())
        if not self.include:
            return usable
        order = F.array_position(F.array(*[F.lit(f) for f in self.include]), F.col("folder"))
        return usable.withColumn("folder_idx", (order - 1).cast("int"))

    def unknown(self, folders: DataFrame, accounts: DataFrame) -> DataFrame:
        """Named folders that an account does not have, as error rows."""
        asked = [(i, f) for i, f in enumerate(self.include) if f not in self.exclude]
        named = F.array(*[F.struct(F.lit(i), F.lit(f)) for i, f in asked]).cast(
            "array<struct<folder_idx:int,folder:string>>"
        )
        usable = folders.filter(~F.array_contains("attributes", NOSELECT))
        return (
            accounts.select("account_idx", "account", F.inline(named))
            .join(usable, ["account", "folder"], "left_anti")
            .select(
                "account_idx",
                "account",
                "folder_idx",
                "folder",
                F.lit("error").alias("status"),
                F.concat(F.lit("cannot open folder "), F.col("folder")).alias("detail"),
            )
        )


def select_folders(
    folders: DataFrame,
    include: tuple[str, ...] = (),
    exclude: tuple[str, ...] = (),
    accounts: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(visited folders, error rows for unknown ones)."""
    choice = FolderChoice(tuple(include), tuple(exclude))
    if accounts is None:
        accounts = folders.select("account_idx", "account").distinct()
    return choice.select(folders), choice.unknown(folders, accounts)
