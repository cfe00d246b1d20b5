"""Column layouts of the tables this engine works on."""

from __future__ import annotations

ACCOUNTS = "account_idx INT, account STRING, host STRING, port INT, user STRING"

FOLDERS = (
    "account_idx INT, account STRING, folder_idx INT, folder STRING, "
    "delimiter STRING, attributes ARRAY<STRING>"
)

# Mutable facts about a message.  Flags are plain booleans so that filters on
# them reach the Parquet scan.
MESSAGES = (
    "account STRING, folder STRING, uid BIGINT, internal_date TIMESTAMP_NTZ, "
    "size BIGINT, from_addr STRING, seen BOOLEAN, flagged BOOLEAN, "
    "deleted BOOLEAN, labels ARRAY<STRING>, origin_folder STRING, origin_uid BIGINT"
)

# Immutable content, keyed by where the message first appeared.  State changes
# never rewrite it.
CONTENTS = (
    "account STRING, origin_folder STRING, origin_uid BIGINT, header BINARY, body BINARY"
)

ARCHIVE = (
    "msg_hash STRING, dup_no BIGINT, length BIGINT, name STRING, account STRING, "
    "folder STRING, uid BIGINT, cycle_id BIGINT"
)

OUTCOMES = (
    "cycle_id BIGINT, command_idx INT, account_idx INT, account STRING, "
    "folder_idx INT, folder STRING, command STRING, uid BIGINT, batch_id BIGINT, "
    "status STRING, detail STRING"
)

MESSAGE_KEY = ["account", "folder", "uid"]
CONTENT_KEY = ["account", "origin_folder", "origin_uid"]
FOLDER_KEY = ["account", "folder"]

NOSELECT = "\\Noselect"
TRASH_LABEL = "\\Trash"
TRASH_FOLDER = "[Gmail]/Trash"
GMAIL_HOST = "imap.gmail.com"

# Default sizes of requests and batches (fixed values).
STORE_NUMBER = 150
FETCH_NUMBER = 150
BATCH_NUMBER = 150
BATCH_SIZE = 4 * 1024 * 1024
