"""Chat formatting: typed content parts flattened into one string per conversation, with a loss mask.

A turn is written as ``<|turn|>`` role ``<|text|>`` body ``<|end|>``. A visitor over the turn's parts
writes text parts escaped and image, audio and document parts as the placeholders ``<|image|>``,
``<|audio|>``, ``<|document|>``, in order, and records their references and expanded token counts. Parts of
other kinds get ``<|part:`` kind ``|>``, which no control string begins with, whatever the kind is called.
Escaping puts a backslash behind each ``<``, ``[`` and backslash, so no text, alone or joined to the
next, can form a control string (all begin with one of these), and taking it away again restores the
text. Built-in column functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
MEDIA = ("image", "audio", "document")
PART = "struct<kind:string,text:string,ref:string,tokens:int>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def _visit(part: Column) -> Column:
    """What a part becomes in the body; a kind that is none of the four is escaped behind a prefix of its own."""
    text = escape(F.coalesce(part["text"], F.lit("")))
    known = F.concat(F.lit("<|"), part["kind"], F.lit("|>"))
    other = F.concat(F.lit("<|part:"), escape(part["kind"]), F.lit("|>"))
    return F.when(F.coalesce(part["kind"], F.lit("text")) == "text", text).when(part["kind"].isin(*MEDIA), known).otherwise(other)


def format_chat(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: str | None = None, learn_from: str = "assistant") -> DataFrame:
    """One row per conversation: its id, ``n_turns``, ``formatted``, ``loss`` (an array of ``turn`` number from 0, ``start``
    and ``length`` in characters of every body of the ``learn_from`` role), ``attachments`` (array of ``turn, kind, ref, tokens``
    in order) and ``expanded_tokens``, their sum.

    ``parts`` names an array of ``PART``; without it the text column is the only part. Turns are ordered by ``turn``,
    ties by role and body. Null texts, roles and part lists are empty; a null kind is text, null tokens are one; rows of a null
    conversation id form one conversation. Other columns are ignored; an empty table gives an empty one. A conversation becomes one value,
    so it must fit into one row.
    """
    content = F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")) if parts else F.array(
        F.struct(F.lit("text").alias("kind"), F.col(text).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).alias("tokens")))
    rows = turns.select(F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), content.alias("parts"))
    is_text = lambda p: F.coalesce(p["kind"], F.lit("text")) == "text"
    rows = rows.select(
        "conv", "turn", "role", F.array_join(F.transform("parts", _visit), "").alias("body"),
        F.transform(F.filter("parts", lambda p: ~is_text(p)), lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), F.coalesce(p["tokens"], F.lit(1)).alias("tokens"))).alias("media"),
    )
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    rows = rows.select("conv", "turn", "role", "media", F.length(head).alias("ahead"), F.length("body").alias("size"), F.concat(head, "body", F.lit(END)).alias("piece"))
    order = Window.partitionBy("conv").orderBy("turn", "role", "piece")
    rows = rows.withColumns({
        "nth": F.row_number().over(order) - 1,
        "before": F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    every = F.array_sort(F.collect_list(F.struct("nth", "before", "ahead", "size", "piece", "role", "media")))
    out = rows.groupBy("conv").agg(every.alias("t"))
    attached = F.flatten(F.transform("t", lambda x: F.transform(x["media"], lambda m: F.struct(x["nth"].alias("turn"), m["kind"].alias("kind"), m["ref"].alias("ref"), m["tokens"].alias("tokens")))))
    learned = F.transform(F.filter("t", lambda x: x["role"] == learn_from), lambda x: F.struct(x["nth"].alias("turn"), (x["before"] + x["ahead"]).alias("start"), x["size"].alias("length")))
    out = out.select(F.col("conv").alias(conv_id), F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), learned.alias("loss"), attached.alias("attachments"))
    return out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def _cut(text: Column, spans: Column, size: int = 1 << 14) -> Column:
    """The pieces of the text at the spans (``start`` from 0 and ``length``, in characters). Substrings are counted from a string's first
    character, so the text is cut into blocks once and a piece is taken from its blocks; each is bound by a lambda, else it were built per span."""
    whole = lambda n: F.floor(n / size).cast("int")
    blocks = lambda t: F.transform(F.sequence(F.lit(0), whole(F.length(t))), lambda i: F.substring(t, i * size + 1, F.lit(size)))

    def piece(b: Column, m: Column) -> Column:
        ahead = m["start"] % size
        near = F.array_join(F.slice(b, whole(m["start"]) + 1, whole(ahead + m["length"]) + 1), "")
        return F.substring(near, (ahead + 1).cast("int"), m["length"].cast("int"))

    found = F.transform(F.transform(F.array(text), blocks), lambda b: F.transform(spans, lambda m: unescape(piece(b, m))))
    return F.get(found, F.lit(0))


def read_back(formatted: DataFrame) -> DataFrame:
    """``turns`` (array of ``role, text``, unescaped; placeholders stay) and ``learned``, the texts under the loss mask (cut out at its
    starts and lengths), from the formatted strings alone and the mask."""
    pieces = F.slice(F.split("formatted", r"<\|end\|>"), F.lit(1), F.size(F.split("formatted", r"<\|end\|>")) - 1)
    cut = F.transform(pieces, lambda p: F.split(F.substring(p, len(TURN) + 1, 1 << 30), r"<\|text\|>"))
    turns = F.transform(cut, lambda c: F.struct(unescape(F.get(c, F.lit(0))).alias("role"), unescape(F.get(c, F.lit(1))).alias("text")))
    return formatted.withColumn("turns", turns).withColumn("learned", _cut(F.col("formatted"), F.col("loss")))
