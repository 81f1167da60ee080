"""Chat formatting with typed content parts (DataFrame operations only).

A turn's content is an array of parts, each a text, an image, an audio clip or a document. The flattener visits the
parts in order: text is escaped, any other part becomes a placeholder that names its kind and position, is recorded as
an attachment reference and expands to a number of tokens worked out from its size. Turns are framed by control strings;
no control string can occur inside escaped text, so that splitting the output on them gives the turns back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchflow.llm.common import table

TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
#: What must never appear inside a text, and where the escape character breaks it.
CONTROL = [("<|", "<\\|"), ("</s>", "<\\/s>"), ("<s>", "<\\s>"), ("[INST]", "[\\INST]"), ("[/INST]", "[\\/INST]")]

PART = "struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    """Double every backslash, then put one inside every control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, broken in CONTROL:
        out = F.replace(out, F.lit(plain), F.lit(broken))
    return out


#: Stands between two texts that adjoin, so that no control string can form across their border; reads back as nothing.
BORDER = "\\0"


def unescape(text: Column) -> Column:
    """The inverse of ``escape``: every backslash stands before the one character that it protects, or is a border's."""
    return F.regexp_replace(text, r"(?s)\\(?:0|(.))", "$1")


def text_parts(text: Column) -> Column:
    """A plain text as its one part; null counts as the empty text."""
    nothing = {"uri": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(
        F.struct(
            F.lit("text").alias("kind"),
            F.coalesce(text, F.lit("")).alias("text"),
            *[F.lit(None).cast(kind).alias(name) for name, kind in nothing.items()],
        )
    )


def flatten_parts(
    df: DataFrame, parts: str = "parts", patch: int = 14, audio_rate: int = 25, page_tokens: int = 256
) -> DataFrame:
    """Add ``content``, ``attachments`` (position, kind, uri, n_tokens, text) and ``expanded_tokens``.

    An image takes ceil(width/patch) * ceil(height/patch) tokens, audio ``audio_rate`` a second, a document
    ``page_tokens`` a page; unknown sizes count as 0. A null array of parts is empty; a part of unknown or null kind is
    recorded as an attachment of that kind ('unknown' if null) with 0 tokens; null text is empty. What a part that is no
    text has as its text goes with its attachment. A placeholder names the kind as the attachment does, percent-encoded.
    Columns of ``df`` that have one of the three names are replaced; all others stay.
    """
    held = "_parts"
    while held in df.columns:
        held += "_"
    kind = lambda p: F.coalesce(p["kind"], F.lit("unknown"))
    n_tokens = lambda p: F.coalesce(
        F.when(kind(p) == "image", F.ceil(p["width"] / patch) * F.ceil(p["height"] / patch))
        .when(kind(p) == "audio", F.ceil(p["seconds"] * audio_rate))
        .when(kind(p) == "document", p["pages"].cast("long") * page_tokens),
        F.lit(0),
    ).cast("long")
    before = lambda i: F.get(F.col(held), i - 1)
    border = lambda i: F.when((i > 0) & (kind(before(i)) == "text"), F.lit(BORDER)).otherwise(F.lit(""))
    visit = lambda p, i: F.when(kind(p) == "text", F.concat(border(i), escape(F.coalesce(p["text"], F.lit(""))))).otherwise(
        F.concat(F.lit("<|"), F.url_encode(kind(p)), F.lit(":"), i.cast("string"), F.lit("|>"))
    )
    all_parts = F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>"))
    listed = F.transform(
        held, lambda p, i: F.struct(i.alias("position"), kind(p).alias("kind"), p["uri"].alias("uri"), n_tokens(p).alias("n_tokens"), p["text"].alias("text"))
    )
    return (
        df.withColumn(held, all_parts)
        .withColumn("content", F.array_join(F.transform(held, visit), ""))
        .withColumn("attachments", F.filter(listed, lambda a: a["kind"] != "text"))
        .withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["n_tokens"]))
        .drop(held)
    )


def read_parts(content: Column) -> Column:
    """The parts that ``content`` was flattened from: array of (kind, position, text) in order.

    A text is unescaped and has no position; texts that adjoined are one, empty ones are none. Any other part has the
    position that its attachment reference has. As escaped text never holds ``<|``, a text that spells out a placeholder
    stays a text.
    """
    nowhere = F.lit(None).cast("int")
    said = lambda t: F.struct(F.lit("text").alias("kind"), nowhere.alias("position"), unescape(t).alias("text"))

    def after_mark(p: Column) -> Column:
        mark = F.substring_index(p, "|>", 1)
        part = F.struct(
            F.url_decode(F.regexp_extract(mark, "^(.*):", 1)).alias("kind"), F.regexp_extract(mark, "([0-9]+)$", 1).cast("int").alias("position"), F.lit(None).cast("string").alias("text")
        )
        return F.array(part, said(F.substr(p, F.length(mark) + 3)))

    pieces = F.transform(F.split(content, r"<\|"), lambda p, i: F.when(i == 0, F.array(said(p))).otherwise(after_mark(p)))
    return F.filter(F.flatten(pieces), lambda p: (p["kind"] != "text") | p["position"].isNotNull() | (p["text"] != ""))


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """One row for each conversation: formatted, loss_spans, attachments, expanded_tokens, n_turns.

    ``turns`` has been through ``flatten_parts``. Turns are ordered by turn, role, content (nulls first), so that ties
    and repeated rows have one result; a null role is the empty role. ``loss_spans`` are [start, length) in code points
    of ``formatted`` that cover what assistants say. A null conversation id is a conversation of its own. One output row
    holds a whole conversation, which is what the format is; offsets come from a window over the same shuffle.
    """
    framed = turns.select(
        F.col(conv).alias("_conv"),
        F.col(turn).alias("_turn"),
        F.coalesce(F.col(role), F.lit("")).alias("_role"),
        F.col("content").alias("_content"),
        F.col("attachments").alias("_att"),
        F.col("expanded_tokens").alias("_exp"),
    ).withColumn("_head", F.concat(F.lit(TURN), escape(F.col("_role")), F.lit(BODY)))
    framed = framed.withColumn("_len", F.length("_head") + F.length("_content") + len(END))
    order = W.partitionBy("_conv").orderBy("_turn", "_role", "_content")
    placed = framed.withColumn("_no", F.row_number().over(order)).withColumn(
        "_at", F.sum("_len").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_len")
    )
    span = F.struct((F.col("_at") + F.length("_head")).alias("start"), F.length("_content").cast("long").alias("length"))
    packed = placed.groupBy("_conv").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "_no",
                    F.concat("_head", "_content", F.lit(END)).alias("piece"),
                    (F.col("_role") == "assistant").alias("loss"),
                    span.alias("span"),
                    F.col("_att").alias("att"),
                )
            )
        ).alias("t"),
        F.sum("_exp").alias("expanded_tokens"),
        F.count(F.lit(1)).alias("n_turns"),
    )
    return packed.select(
        F.col("_conv").alias(conv),
        "n_turns",
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["loss"]), lambda x: x["span"]).alias("loss_spans"),
        F.flatten(
            F.transform("t", lambda x: F.transform(x["att"], lambda a: F.struct((x["_no"] - 1).alias("turn"), a["position"].alias("position"), a["kind"].alias("kind"), a["uri"].alias("uri"), a["n_tokens"].alias("n_tokens"), a["text"].alias("text"))))
        ).alias("attachments"),
        "expanded_tokens",
    )


def read_back(formatted: Column) -> Column:
    """The turns inside a formatted conversation: array of (role, text, content).

    ``text`` is unescaped, with placeholders in it; ``content`` is as it was flattened, for ``read_parts``.
    """
    pieces = F.filter(F.split(formatted, r"<\|turn\|>"), lambda p: p != "")
    cut = lambda p: F.split(F.regexp_replace(p, r"<\|end\|>$", ""), r"<\|text\|>")
    return F.transform(
        pieces, lambda p: F.struct(unescape(cut(p)[0]).alias("role"), unescape(cut(p)[1]).alias("text"), cut(p)[1].alias("content"))
    )


def under_mask(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss_spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(probe).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    chats = format_chat(flatten_parts(turns.withColumn("parts", text_parts(F.col("text")))))
    back = chats.withColumn("back", read_back(F.col("formatted")))
    said = under_mask(F.col("formatted"), F.col("loss_spans"))
    whole = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(said).cast("long").alias("loss_chars"),
        F.sha2(said, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _escaped_sql(col: str) -> str:
    out = f"replace({col}, '\\', '\\\\')"
    for plain, broken in CONTROL:
        out = f"replace({out}, '{plain}', '{broken}')"
    return out


OP1_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length({_escaped_sql('role')}) + length({_escaped_sql('text')}) + {len(TURN + BODY + END)}) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
