"""Exports of other programs as tables of texts: browser history, chats, mail, bookmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def webkit_time(micros: Column) -> Column:
    """Microseconds since 1601 as a timestamp."""
    return F.timestamp_micros(micros - 11_644_473_600_000_000)


def cocoa_time(nanos: Column) -> Column:
    """Nanoseconds since 2001 as a timestamp."""
    return F.timestamp_micros((nanos / 1000).cast("long") + 978_307_200_000_000)


def browser_history(urls: DataFrame, most: int | None = None) -> DataFrame:
    """``(url, text)`` of a history table, latest visit first."""
    at = webkit_time(F.col("last_visit_time"))
    text = F.format_string("[Title]: %s\n[URL]: %s\n[Last visited]: %s\n[Visits]: %s\n[Typed]: %s", F.coalesce("title", F.lit("")), F.col("url"), F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.col("visit_count").cast("string"), F.col("typed_count").cast("string"))
    rows = urls.select("url", text.alias("text"), "last_visit_time").orderBy(F.desc("last_visit_time"), "url")
    return (rows.limit(most) if most else rows).drop("last_visit_time")


def phone_messages(message: DataFrame, chat_message: DataFrame, chat: DataFrame, handle: DataFrame) -> DataFrame:
    """``(message_id, text, sent_at, from_me, handle, chat)`` of messages with text, by three left joins."""
    m = message.filter("text is not null and text <> ''").select(F.col("ROWID").alias("message_id"), "text", cocoa_time(F.col("date")).alias("sent_at"), F.col("is_from_me").alias("from_me"), "handle_id")
    cm = chat_message.select(F.col("message_id"), F.col("chat_id"))
    c = chat.select(F.col("ROWID").alias("chat_id"), F.coalesce("display_name", "chat_identifier").alias("chat"))
    h = handle.select(F.col("ROWID").alias("handle_id"), F.col("id").alias("handle"))
    return m.join(h, "handle_id", "left").join(cm, "message_id", "left").join(c, "chat_id", "left").select("message_id", "text", "sent_at", "from_me", "handle", "chat")


def _first(v: Column, *paths: str) -> Column:
    return F.coalesce(*[F.try_variant_get(v, p, "string") for p in paths])


def chat_export(raw: DataFrame, json_col: str = "json") -> DataFrame:
    """``(conversation, title, turn, role, text, at)`` of an assistant's JSON export in any of its shapes.

    A list, ``conversations``, ``messages`` or a single conversation; fields go by several names. Texts of fewer than
    3 characters are dropped; a missing title is the start of the first user message.
    """
    v = F.try_parse_json(F.col(json_col))
    listed = lambda p: F.try_variant_get(v, p, "array<variant>")
    whole = raw.select(F.coalesce(listed("$"), listed("$.conversations"), F.array(v)).alias("c"))
    each = whole.select(F.posexplode("c").alias("conversation", "v"))
    items = F.coalesce(*[F.try_variant_get("v", p, "array<variant>") for p in ("$.messages", "$.chat_messages", "$.mapping")])
    rows = each.select("conversation", _first(F.col("v"), "$.title", "$.name").alias("title"), F.posexplode(items).alias("turn", "m"))
    text = F.trim(_first(F.col("m"), "$.content", "$.text", "$.message"))
    role = F.lower(_first(F.col("m"), "$.role", "$.sender", "$.author"))
    named = F.when(role.isin("human", "user"), "user").when(role.isin("assistant", "ai", "bot"), "assistant").otherwise(role)
    out = rows.select("conversation", "title", "turn", named.alias("role"), text.alias("text"), _first(F.col("m"), "$.timestamp", "$.created_at", "$.create_time").alias("at")).filter(F.length("text") >= 3)
    firsts = out.filter("role = 'user'").groupBy("conversation").agg(F.min_by(F.substring("text", 1, 50), "turn").alias("start"))
    return out.join(firsts, "conversation", "left").withColumn("title", F.coalesce("title", "start")).drop("start")


def infer_role(classes: Column, text: Column) -> Column:
    """The speaker by CSS class, else by the text's beginning."""
    c, t = F.lower(F.coalesce(classes, F.lit(""))), F.lower(F.ltrim(text))
    return F.when(c.rlike("user|human"), "user").when(c.rlike("assistant|ai|gpt"), "assistant").when(t.rlike("^(you|user|human):"), "user").when(t.rlike("^(chatgpt|assistant|ai):"), "assistant").otherwise("unknown")


def strip_role(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?i)^\s*(you|user|human|chatgpt|assistant|ai):\s*", ""))


def messenger(messages: DataFrame, text_col: str = "content") -> DataFrame:
    """Text messages of a messenger: without images, stickers, voice, video and application messages; the sender's prefix is cut."""
    plain = messages.filter(~F.coalesce(F.col(text_col), F.lit("")).rlike(r"<(img|emoji|voicemsg|videomsg|appmsg)\b") & (F.trim(text_col) != ""))
    return plain.withColumn(text_col, F.regexp_replace(text_col, r"^\w[\w\-]*:\s*\n", ""))


def unescaped(text: Column) -> Column:
    """XML entities as characters."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def quoted_message(xml: Column, depth: int = 4) -> Column:
    """Title of an XML message, with what it quotes in brackets, itself a message perhaps, up to ``depth`` of them; text that isn't XML as it is."""
    is_xml = F.ltrim(xml).startswith("<")
    title, inner = unescaped(F.regexp_extract(xml, r"(?s)<title>(.*?)</title>", 1)), unescaped(F.regexp_extract(xml, r"(?s)<refermsg>.*?<content>(.*?)</content>", 1))
    if depth > 1:
        inner = quoted_message(inner, depth - 1)
    return F.when(is_xml & (inner != ""), F.concat(title, F.lit(" ["), inner, F.lit("]"))).when(is_xml & (title != ""), title).otherwise(xml)


def team_chat(messages: DataFrame, most: int | None = None) -> DataFrame:
    """``(channel, n_messages, text)`` of ``(channel, ts, user, text)``: the last messages of each channel in order."""
    from lodestone.operators.conversations import last_n

    rows = last_n(messages, most, "channel", ["ts", "text"]) if most else messages
    line = F.concat(F.lit("["), F.col("ts").cast("string"), F.lit("] "), F.coalesce("user", F.lit("unknown")), F.lit(": "), F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("ts", line.alias("l"))))
    return rows.groupBy("channel").agg(F.count("*").alias("n_messages"), F.array_join(F.transform(ordered, lambda x: x["l"]), "\n").alias("text"))


def bookmarks(rows: DataFrame) -> DataFrame:
    """``(id, text)`` of saved posts ``(id, author, username, text, full_text, created_at, url, likes)``; absent parts have no line."""
    part = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit(label), c))
    date = F.date_format(F.try_to_timestamp("created_at"), "yyyy-MM-dd HH:mm:ss")
    return rows.select("id", F.concat_ws("\n", F.coalesce("full_text", "text"), part("Author: ", F.coalesce("author", F.concat(F.lit("@"), F.col("username")))), part("Date: ", F.coalesce(date, F.col("created_at"))), part("URL: ", F.col("url")), part("Likes: ", F.col("likes").cast("string"))).alias("text"))


def mail_corpus(raw: DataFrame, id_col: str = "file", text_col: str = "message") -> DataFrame:
    """``(message_id, headers, body)``: split at the first blank line; the id from the headers, else the file's."""
    parts = F.split(F.regexp_replace(F.col(text_col), "\r\n", "\n"), "\n\n", 2)
    ident = F.regexp_extract(parts[0], r"(?im)^message-id:\s*<?([^>\s]+)", 1)
    return raw.select(F.when(ident != "", ident).otherwise(F.col(id_col).cast("string")).alias("message_id"), parts[0].alias("headers"), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("body"))


def kinds(rows: DataFrame, kind_col: str, k: int = 5) -> DataFrame:
    """The k most frequent kinds of a file index with their counts."""
    return rows.groupBy(kind_col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), kind_col).limit(k)


def folders(rows: DataFrame, path_col: str = "path") -> DataFrame:
    """``(folder, n)``: the files directly in each folder, most first."""
    folder = F.regexp_extract(F.col(path_col), r"^(.*)/[^/]*$", 1)
    return rows.groupBy(folder.alias("folder")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "folder")


def chat_html(raw: DataFrame, html_col: str = "html", id_col: str = "id") -> DataFrame:
    """``(id, turn, role, text)`` of chats saved as HTML: elements whose class speaks of a message or turn; the whole text if there is none."""
    import re
    from collections.abc import Iterator

    import pyarrow as pa

    from .readers import html_to_text

    box = re.compile(r"<(div|article|section|li)\b[^>]*class=[\"']([^\"']*(?:message|turn|user|assistant|human|gpt)[^\"']*)[\"'][^>]*>", re.I)

    def split(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for ident, page in zip(part.column("i").to_pylist(), part.column("h").to_pylist()):
                at = list(box.finditer(page or ""))
                pieces = [(m[2], html_to_text(page[m.end() : n])) for m, n in zip(at, [m.start() for m in at[1:]] + [len(page or "")])]
                rows += [(ident, k, c, t) for k, (c, t) in enumerate(p for p in (pieces or [("", html_to_text(page or ""))]) if len(p[1]) >= 3)]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.string()))], names=["id", "turn", "classes", "text"])

    rows = raw.select(F.col(id_col).cast("string").alias("i"), F.col(html_col).alias("h")).mapInArrow(split, "id string, turn int, classes string, text string")
    return rows.select("id", "turn", infer_role(F.col("classes"), F.col("text")).alias("role"), strip_role(F.col("text")).alias("text"))
