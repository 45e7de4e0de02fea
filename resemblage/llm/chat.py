"""Chat formatting: typed content parts become one text with ordered placeholders.

A message is a list of parts: text, image, audio or document. Visiting the parts
in order, text goes through as it is (but for what would read as a marker), and
any other part leaves a numbered placeholder, a record of what it refers to and
the number of tokens that it expands to. All of it runs in the JVM: one shuffle
by conversation serves the numbering and the joining of the parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import pick

KINDS = ("text", "image", "audio", "document")
PART = T.StructType(
    [T.StructField(n, k) for n, k in (("type", T.StringType()), ("text", T.StringType()), ("url", T.StringType()), ("width", T.LongType()), ("height", T.LongType()), ("seconds", T.DoubleType()), ("pages", T.LongType()))]
)
#: An image has a token for each square patch of so many pixels; the sides that are not told are taken for SIDE.
PATCH, SIDE = 28, 336
#: Tokens of a second of audio and of a page; a clip or document that doesn't tell is taken for so many seconds, or pages.
SECOND, SECONDS, PAGE, PAGES = 25, 30, 576, 1
#: Markers of a message, each a token.
MARKERS = 2
#: A token of text is a word or a mark.
_TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def text_tokens(text: Column) -> Column:
    """Words and marks of a text. Any other count of a text column may be given in its place."""
    return F.size(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))).cast("long")


def _whole(x: Column, usual: int) -> Column:
    return F.when(x > 0, x).otherwise(F.lit(usual))


def _expanded(part: Column, count) -> Column:
    image = F.ceil(_whole(part["width"], SIDE) / PATCH) * F.ceil(_whole(part["height"], SIDE) / PATCH)
    audio = F.ceil(_whole(part["seconds"], SECONDS) * SECOND)
    pages = _whole(part["pages"], PAGES) * PAGE
    kind = part["type"]
    return F.when(kind == "text", count(F.coalesce(part["text"], F.lit("")))).when(kind == "image", image).when(kind == "audio", audio).otherwise(pages).cast("long")


def parts_of(text: Column) -> Column:
    """A message's parts: those of a JSON array of objects that all have a known type, else the text as one part."""
    given = F.from_json(text, T.ArrayType(PART))
    typed = F.startswith(F.trim(text), F.lit("[")) & (F.size(given) > 0) & F.forall(given, lambda p: F.coalesce(p["type"].isin(*KINDS), F.lit(False)))
    plain = F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in PART.fields[2:]]))
    return F.when(F.coalesce(typed, F.lit(False)), given).otherwise(plain)


def format_chats(messages: DataFrame, count=text_tokens) -> DataFrame:
    """``conversations`` -> ``(conv_id, n_messages, text, attachments, text_tokens, attachment_tokens, n_tokens)`` for each conversation.

    Messages are in the order of ``turn`` (nulls last; ties by role, then text);
    each is ``<|role|>``, a line end, its parts, ``<|end|>``, a line end. A part that is no text
    becomes ``<|kind_number|>``, numbered through the conversation, and a struct
    ``(number, kind, ref, tokens)`` of ``attachments``. "<|" in a text becomes "&lt;|". Null text is
    empty, a null role "unknown", and rows whose ``conv_id`` is null are one conversation; repeated rows
    are messages of their own. Very long texts are read whole; no rows give none; other columns are ignored, whatever their names. ``count`` is what
    a text's tokens are counted with; ``bpe.token_count`` counts those of a vocabulary. ``n_tokens`` is text, attachments and the markers of each message together.
    """
    own = Window.partitionBy("conv_id")
    rows = pick(messages, "conv_id", "turn", "role", "text").withColumn("role", F.coalesce("role", F.lit("unknown")))
    rows = rows.withColumn("m", F.row_number().over(own.orderBy(F.col("turn").asc_nulls_last(), "role", F.col("text").asc_nulls_first())))
    rows = rows.select("conv_id", "m", "role", F.posexplode(parts_of(F.col("text"))).alias("p", "part"), F.size(parts_of(F.col("text"))).alias("n_parts"))
    other = F.col("part.type") != "text"
    rows = rows.withColumn("number", F.sum(other.cast("long")).over(own.orderBy("m", "p").rowsBetween(Window.unboundedPreceding, 0)))
    mark = F.when(other, F.concat(F.lit("<|"), F.col("part.type"), F.lit("_"), F.col("number").cast("string"), F.lit("|>")))
    piece = F.concat(
        F.when(F.col("p") == 0, F.concat(F.lit("<|"), F.replace("role", F.lit("|"), F.lit("")), F.lit("|>\n"))).otherwise(""),
        F.coalesce(mark, F.replace(F.coalesce("part.text", F.lit("")), F.lit("<|"), F.lit("&lt;|"))),
        F.when(F.col("p") == F.col("n_parts") - 1, F.lit("<|end|>\n")).otherwise(""),
    )
    attachment = F.when(other, F.struct("number", F.col("part.type").alias("kind"), F.coalesce("part.url", F.lit("")).alias("ref"), F.col("tokens")))
    rows = rows.withColumn("tokens", _expanded(F.col("part"), count)).select("conv_id", "m", F.struct("m", "p", piece.alias("piece"), attachment.alias("a")).alias("x"), other.alias("other"), "tokens")
    chats = rows.groupBy("conv_id").agg(
        F.max("m").cast("long").alias("n_messages"), F.array_sort(F.collect_list("x")).alias("xs"),
        F.coalesce(F.sum(F.when(~F.col("other"), F.col("tokens"))), F.lit(0)).alias("text_tokens"), F.coalesce(F.sum(F.when(F.col("other"), F.col("tokens"))), F.lit(0)).alias("attachment_tokens"),
    )
    return chats.select(
        "conv_id", "n_messages", F.array_join("xs.piece", "").alias("text"), F.array_compact("xs.a").alias("attachments"), "text_tokens", "attachment_tokens",
        (F.col("text_tokens") + F.col("attachment_tokens") + MARKERS * F.col("n_messages")).alias("n_tokens"),
    )


def as_text(chats: DataFrame) -> DataFrame:
    """``format_chats``'s rows with ``attachments`` as a text, a line "number kind tokens ref" for each."""
    line = F.transform("attachments", lambda a: F.concat_ws(" ", a["number"].cast("string"), a["kind"], a["tokens"].cast("string"), a["ref"]))
    return chats.withColumn("attachments", F.array_join(line, "\n"))


def typed(messages: DataFrame) -> DataFrame:
    """``conversations`` with the text of each message as typed parts: the text, what goes with its place, and the role as a text again."""
    rows = pick(messages, "conv_id", "turn", "role", "text")
    none = {f.name: F.lit(None).cast(f.dataType) for f in PART.fields}

    def part(**given: Column) -> Column:
        return F.struct(*[given.get(n, x).cast(x_type).alias(n) for (n, x), x_type in zip(none.items(), [f.dataType for f in PART.fields])])

    c, t, name = F.col("conv_id"), F.col("turn"), F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    image = part(type=F.lit("image"), url=F.concat(name, F.lit(".png")), width=c % 700, height=t * 100)
    audio = part(type=F.lit("audio"), url=F.concat(name, F.lit(".wav")), seconds=(c % 100) / 8)
    document = part(type=F.lit("document"), url=F.concat(name, F.lit(".pdf")), pages=c % 7)
    more = F.when(c % 4 == 0, F.array(image)).when(c % 4 == 1, F.array(audio, image)).when(c % 4 == 2, F.array(document, document, audio)).otherwise(F.array(part(type=F.lit("text"), text=F.lit("<|end|>"))))
    parts = F.concat(F.array(part(type=F.lit("text"), text=F.col("text"))), more, F.array(part(type=F.lit("text"), text=F.col("role"))))
    return rows.withColumn("text", F.to_json(parts))


def _sql(conversations: str) -> str:
    return f"""
WITH r AS (SELECT conv_id, coalesce(role, 'unknown') AS role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'unknown'), text NULLS FIRST) AS m FROM {conversations}),
j AS (SELECT *, CASE WHEN trim(text) LIKE '[%' AND json_valid(text) THEN TRY(from_json(text,
     '[{{"type":"VARCHAR","text":"VARCHAR","url":"VARCHAR","width":"BIGINT","height":"BIGINT","seconds":"DOUBLE","pages":"BIGINT"}}]')) END AS given FROM r),
k AS (SELECT conv_id, role, m, CASE WHEN len(given) > 0 AND len(list_filter(given, lambda x: coalesce(x.type IN {KINDS}, false))) = len(given) THEN given
     ELSE [{{'type': 'text', 'text': coalesce(text, ''), 'url': NULL::VARCHAR, 'width': NULL::BIGINT, 'height': NULL::BIGINT, 'seconds': NULL::DOUBLE, 'pages': NULL::BIGINT}}] END AS parts FROM j),
e AS (SELECT conv_id, role, m, len(parts) AS n, unnest(parts) AS part, unnest(range(len(parts))) AS p FROM k),
v AS (SELECT *, sum((part.type <> 'text')::INT) OVER (PARTITION BY conv_id ORDER BY m, p ROWS UNBOUNDED PRECEDING)::BIGINT AS number,
     CASE part.type WHEN 'text' THEN len(regexp_extract_all(coalesce(part.text, ''), '{_TOKEN}'))
          WHEN 'image' THEN ceil(CASE WHEN part.width > 0 THEN part.width ELSE {SIDE} END / {PATCH}) * ceil(CASE WHEN part.height > 0 THEN part.height ELSE {SIDE} END / {PATCH})
          WHEN 'audio' THEN ceil(CASE WHEN part.seconds > 0 THEN part.seconds ELSE {SECONDS} END * {SECOND})
          ELSE CASE WHEN part.pages > 0 THEN part.pages ELSE {PAGES} END * {PAGE} END::BIGINT AS tokens FROM e),
w AS (SELECT *, CASE WHEN p = 0 THEN '<|' || replace(role, '|', '') || '|>' || chr(10) ELSE '' END
     || CASE WHEN part.type <> 'text' THEN '<|' || part.type || '_' || number || '|>' ELSE replace(coalesce(part.text, ''), '<|', '&lt;|') END
     || CASE WHEN p = n - 1 THEN '<|end|>' || chr(10) ELSE '' END AS piece FROM v),
g AS (SELECT conv_id, max(m) AS n_messages, string_agg(piece, '' ORDER BY m, p) AS text,
     coalesce(string_agg(number || ' ' || part.type || ' ' || tokens || ' ' || coalesce(part.url, ''), chr(10) ORDER BY number) FILTER (part.type <> 'text'), '') AS attachments,
     coalesce(sum(tokens) FILTER (part.type = 'text'), 0)::BIGINT AS text_tokens, coalesce(sum(tokens) FILTER (part.type <> 'text'), 0)::BIGINT AS attachment_tokens FROM w GROUP BY conv_id)
SELECT *, text_tokens + attachment_tokens + {MARKERS} * n_messages AS n_tokens FROM g
"""


_MORE = {
    0: "[json_object('type', 'image', 'url', name || '.png', 'width', conv_id % 700, 'height', turn * 100)]",
    1: "[json_object('type', 'audio', 'url', name || '.wav', 'seconds', (conv_id % 100) / 8), json_object('type', 'image', 'url', name || '.png', 'width', conv_id % 700, 'height', turn * 100)]",
    2: "[json_object('type', 'document', 'url', name || '.pdf', 'pages', conv_id % 7), json_object('type', 'document', 'url', name || '.pdf', 'pages', conv_id % 7), json_object('type', 'audio', 'url', name || '.wav', 'seconds', (conv_id % 100) / 8)]",
    3: "[json_object('type', 'text', 'text', '<|end|>')]",
}
_CASES = " ".join(f"WHEN {k} THEN {v}" for k, v in _MORE.items())
SQL = _sql("conversations")
#: The same for ``typed`` conversations.
TYPED_SQL = _sql(
    f"(SELECT conv_id, turn, role, to_json([json_object('type', 'text', 'text', text)] || CASE conv_id % 4 {_CASES} END || [json_object('type', 'text', 'text', role)])::VARCHAR AS text FROM (SELECT *, conv_id || '/' || turn AS name FROM conversations))"
)
