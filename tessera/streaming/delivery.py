"""Delivery of messages as a data source: sent by the tasks, marked as shown once all of them have ended well."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Sends one message: chat, text.
Send = Callable[[str, str], None]
#: Takes a key once: true for the first who asks, false ever after.
Claim = Callable[[str], bool]


class FileClaims:
    """Claims as files of a folder that all executors see, made exclusively."""

    def __init__(self, folder: str):
        self.folder = folder

    def __call__(self, key: str) -> bool:
        os.makedirs(self.folder, exist_ok=True)
        try:
            os.close(os.open(os.path.join(self.folder, key), os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        except FileExistsError:
            return False
        return True


def delivery_source(send: Send, claim: Claim) -> type[DataSource]:
    class Writer(DataSourceWriter):
        def write(self, iterator: Iterator) -> WriterCommitMessage:
            # Claimed before it is sent: a task that is run again passes over what an attempt has sent.
            for chat, text, key in iterator:
                if claim(key):
                    send(chat, text)
            return WriterCommitMessage()

    class ChatDelivery(DataSource):
        @classmethod
        def name(cls) -> str:
            return "chat_delivery"

        def schema(self) -> str:
            return "chat_id string, message string, key string"

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            return Writer()

    return ChatDelivery


def deliver(messages: DataFrame, send: Send, claim: Claim, shown: Callable[[DataFrame], None] | None = None, chat: str = "chat_id", text: str = "message", order: str = "rank", item: str = "result_id") -> None:
    """Send each chat's messages in their order, none twice, and hand what was sent to ``shown``.

    Chats are spread over tasks; a chat's messages go from one task, one after the other.  A
    message's key is its chat and item.  If a task fails for good, ``save`` raises and
    nothing is marked; sending again goes on with what hasn't been claimed.
    """
    key = F.sha2(F.concat_ws("\x1f", F.col(chat).cast("string"), F.col(item).cast("string")), 256)
    spark = messages.sparkSession
    spark.dataSource.register(delivery_source(send, claim))
    rows = messages.repartition(F.col(chat)).sortWithinPartitions(chat, order)
    rows.select(F.col(chat).cast("string").alias("chat_id"), F.col(text).alias("message"), key.alias("key")).write.format("chat_delivery").mode("append").save()
    if shown is not None:
        shown(messages)
