"""Group chats over the HTTP interface of a chat bridge: their history as a batch, and what comes as a stream.

Both read `{base}/get_group_msg_history?group_id=..&message_seq=..&count=..`, which gives up to count messages up to a sequence
number, backwards, the newest ones for 0. A pushed message can't be asked for again; one that is read by its number can, so a batch
that is lost is read again and no message is lost or doubled.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..schemas import CHAT
from .records import chat_messages

#: Where the history is read backwards from, the newest message first, and what tells that a group is none.
STARTS = (0, 100_000, 200_000, 500_000)
NO_GROUP = "群不存在"
FORMAT = "group_chat"


def _get(base: str, call: str, **arguments) -> dict:
    with urllib.request.urlopen(f"{base.rstrip('/')}/{call}?{urllib.parse.urlencode(arguments)}", timeout=15) as reply:
        return json.loads(reply.read())


def _page(base: str, group: str, upto: int, count: int) -> list[dict]:
    """Messages of a group up to a sequence number; a group that isn't there has none, any other failure is Spark's to try again."""
    reply = _get(base, "get_group_msg_history", group_id=group, message_seq=upto, count=count)
    if reply.get("status") != "ok":
        if NO_GROUP in str(reply.get("wording", "")):
            return []
        raise OSError(f"history of {group}: {reply.get('wording') or reply.get('status')}")
    return (reply.get("data") or {}).get("messages") or []


def _row(message: dict, group: str) -> tuple:
    event = {"post_type": "message", "message_type": "group", **message, "group_id": str(message.get("group_id", group))}
    if not isinstance(event.get("message"), list):  # plain text
        event["raw_message"], event["message"] = event.get("raw_message") or event.get("message") or "", []
    event |= {k: str(event[k]) for k in ("user_id", "message_id") if event.get(k) is not None}
    return event["group_id"], int(message.get("message_seq") or 0), json.dumps(event, ensure_ascii=False)


@dataclass
class Range(InputPartition):
    """Messages of a group after one sequence number, up to another."""

    group: str
    after: int
    upto: int


class _Groups:
    def __init__(self, options: dict):
        self.base, self.count = options["base"], int(options.get("count", 100))
        self.named = [g for g in options.get("groups", "").split(",") if g]
        self.starts = [int(s) for s in options.get("starts", "").split(",") if s] or list(STARTS)

    def groups(self) -> list[str]:
        return self.named or sorted(str(g["group_id"]) for g in _get(self.base, "get_group_list").get("data") or [])


class HistoryReader(_Groups, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [Range(g, -1, start) for g in self.groups() for start in self.starts]

    def read(self, partition: Range) -> Iterator[tuple]:
        for message in _page(self.base, partition.group, partition.upto, self.count):
            yield _row(message, partition.group)


class LiveReader(_Groups, DataSourceStreamReader):
    """Offsets are the last sequence number of each group. A group that appears later is read from its beginning."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        newest = {}
        for group in self.groups():
            page = _page(self.base, group, 0, 1)
            newest[group] = max((int(m.get("message_seq") or 0) for m in page), default=0)
        return newest

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Range(g, start.get(g, 0), upto) for g, upto in sorted(end.items()) if upto > start.get(g, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        upto = partition.upto
        while upto > partition.after:
            page = [m for m in _page(self.base, partition.group, upto, self.count) if partition.after < int(m.get("message_seq") or 0) <= upto]
            if not page:
                return
            for message in page:
                yield _row(message, partition.group)
            upto = min(int(m["message_seq"]) for m in page) - 1


class GroupChat(DataSource):
    """Options: base, the bridge's address; groups, their numbers with commas, or all; count, messages of a page; starts, of the history."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "group_id string, message_seq long, event string"

    def reader(self, schema) -> DataSourceReader:
        return HistoryReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LiveReader(self.options)


def _messages(events: DataFrame) -> DataFrame:
    said = events.select("message_seq", F.from_json("event", CHAT).alias("e")).select("message_seq", "e.*")
    return chat_messages(said)


def history(spark: SparkSession, base: str, groups: tuple[str, ...] = (), count: int = 100, starts: tuple[int, ...] = STARTS) -> DataFrame:
    """The groups' messages as chat_messages() gives them, each once, from several sequence numbers backwards; a task each."""
    spark.dataSource.register(GroupChat)
    rows = spark.read.format(FORMAT).options(base=base, groups=",".join(groups), count=str(count), starts=",".join(map(str, starts))).load()
    return _messages(rows.dropDuplicates(["group_id", "message_seq"])).dropDuplicates(["group_id", "message_id"])


def live(spark: SparkSession, base: str, groups: tuple[str, ...] = (), count: int = 100) -> DataFrame:
    """A stream of the groups' messages as chat_messages() gives them, each once, whatever is restarted."""
    spark.dataSource.register(GroupChat)
    return _messages(spark.readStream.format(FORMAT).options(base=base, groups=",".join(groups), count=str(count)).load())
