"""Small mailboxes for tests."""

import datetime as dt

from lettermill.plans.pipeline import Mailbox
from lettermill.schema import ACCOUNTS, FOLDERS

NOW = dt.datetime(2024, 1, 31)
OLD = dt.datetime(2024, 1, 1)
NEW = dt.datetime(2024, 1, 30)

_MESSAGE = (
    "account string, folder string, uid bigint, internal_date timestamp_ntz, size bigint, "
    "from_addr string, seen boolean, flagged boolean, deleted boolean, labels array<string>, "
    "origin_folder string, origin_uid bigint, header binary, body binary"
)


def message(account, folder, uid, date=OLD, seen=False, flagged=False, deleted=False,
            body=b"hello", size=10, header=b"From: x\r\n\r\n"):
    return (account, folder, uid, date, size, "x@example.com", seen, flagged, deleted, [],
            folder, uid, header, body)


def mailbox(spark, rows, accounts=(("a", "imap.example.com"), ("b", "imap.example.com")),
            names=("INBOX", "Lists", "[Gmail]/Trash")):
    return Mailbox(
        spark.createDataFrame(
            [(i, a, h, 993, f"user-{a}") for i, (a, h) in enumerate(accounts)], ACCOUNTS
        ),
        spark.createDataFrame(
            [(i, a, j, f, "/", []) for i, (a, _) in enumerate(accounts)
             for j, f in enumerate(names)], FOLDERS,
        ),
        spark.createDataFrame(rows, _MESSAGE),
    )


def keys(df):
    return sorted((r.account, r.folder, r.uid) for r in df.select("account", "folder", "uid").collect())
