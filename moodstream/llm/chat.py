"""Chat formatting: typed content parts flattened by a visitor, turns marked, control strings escaped reversibly."""

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodstream.llm.shared import stored, table

OPEN, BODY, CLOSE = "<s>", "[INST] ", " [/INST]</s>"
LEARNED = "assistant"
MARKS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
CONTROL = ["</s>", "<s>", "[/INST]", "[INST]", *MARKS.values()]
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escaped(text: Column) -> Column:
    """A text in which no control string occurs: backslashes doubled, one put behind a control string's first character."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for word in CONTROL:
        out = F.replace(out, F.lit(word), F.lit(word[0] + "\\" + word[1:]))
    return out


def unescaped(text: Column) -> Column:
    """The inverse: every backslash stands before a character that is meant as it is."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _visit_text(part: Column) -> tuple[Column, Column]:
    return escaped(F.coalesce(part["text"], F.lit(""))), F.lit(0)


def _visit_image(part: Column) -> tuple[Column, Column]:
    tiles = F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH)
    return F.lit(MARKS["image"]), F.greatest(F.lit(1), F.coalesce(tiles, F.lit(1)))


def _visit_audio(part: Column) -> tuple[Column, Column]:
    return F.lit(MARKS["audio"]), F.greatest(F.lit(1), F.coalesce(F.ceil(part["seconds"] * AUDIO_RATE), F.lit(1)))


def _visit_document(part: Column) -> tuple[Column, Column]:
    return F.lit(MARKS["document"]), F.greatest(F.lit(1), F.coalesce(part["pages"] * PAGE_TOKENS, F.lit(PAGE_TOKENS)))


#: What to write for a part of each kind, and how many tokens its placeholder stands for.
VISITORS = {"text": _visit_text, "image": _visit_image, "audio": _visit_audio, "document": _visit_document}


def _visited(part: Column, which: int) -> Column:
    out = F.raise_error(F.concat(F.lit("no visitor for a part of kind "), F.coalesce(part["kind"], F.lit("null"))))
    out = out.cast("string" if which == 0 else "bigint")
    for kind, visit in reversed(VISITORS.items()):
        out = F.when(part["kind"] == kind, visit(part)[which]).otherwise(out)
    return out


def formatted(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, tie, piece, attachments, expanded): a formatted piece for each message.

    `messages` has conv_id, turn, role and either text or parts (an array of PART). A conversation is its pieces in the
    order of turn (null last), then tie, a hash of the message. The pieces of a long conversation are never joined in
    one row. Parts keep their order: texts are escaped, others leave a placeholder, an attachment (position, kind, ref,
    tokens), and the tokens it expands to. Null roles and texts are empty; an unknown kind of part is an error; repeated
    messages are all turns.
    """
    if "parts" in messages.columns:
        parts = F.coalesce(F.col("parts").cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>"))
    else:
        nothing = [F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
        parts = F.array(F.struct(F.lit("text").alias("kind"), F.col("text").alias("text"), *nothing))
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    body = F.array_join(F.transform("parts", lambda p: _visited(p, 0)), "")
    others = F.filter("parts", lambda p: p["kind"] != "text")
    attachments = F.transform(
        others,
        lambda p, i: F.struct(i.cast("int").alias("position"), p["kind"].alias("kind"), p["ref"].alias("ref"), _visited(p, 1).alias("tokens")),
    )
    rows = rows.select(
        "conv_id",
        "turn",
        F.xxhash64("role", body).alias("tie"),
        F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(BODY), body, F.lit(CLOSE)).alias("piece"),
        attachments.alias("attachments"),
    )
    tokens = F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    return rows.withColumn("expanded", tokens)


def parsed(pieces: DataFrame) -> DataFrame:
    """`pieces` with role, text (placeholders left out) and learned, read back from each piece."""
    shape = "(?s)^" + _quoted(OPEN) + "(.*?)" + _quoted(BODY) + "(.*)" + _quoted(CLOSE) + "$"
    body = F.regexp_extract("piece", shape, 2)
    for mark in MARKS.values():
        body = F.replace(body, F.lit(mark), F.lit(""))
    role = unescaped(F.regexp_extract("piece", shape, 1))
    return pieces.select("*", role.alias("role"), unescaped(body).alias("text"), (role == LEARNED).alias("learned"))


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def digests(pieces: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), from the parsed pieces.

    Turns of a conversation stream through one task in order, as their digest asks for; no more than a batch of them is
    ever held, and Spark's sort spills.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def each(batches):
        conv, state, out = None, None, []
        for batch in batches:
            for c, role, text, learned, size in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if state is None or c != conv:
                    if state:
                        out.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if learned:
                    state[2] += len(text)
                    state[3].update(text.encode("utf-8", "surrogatepass"))
                state[4] += size
            if len(out) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out = []
        if state:
            out.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

    rows = pieces.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_last("turn"), "tie")
    rows = parsed(rows).select(F.col("conv_id").cast("long"), "role", "text", "learned", F.length("piece").cast("long").alias("size"))
    return rows.mapInArrow(each, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, and of one that is made of control strings, read back from the formatted pieces."""
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], messages.schema)
    return digests(stored(formatted(messages.union(extra)).select("conv_id", "turn", "tie", "piece"), "pieces"))


QUERIES = {"op4_chat_format": op4_chat_format}


def _sql_escaped(column: str) -> str:
    out = f"replace(coalesce({column}, ''), '\\', '\\\\')"
    for word in CONTROL:
        out = f"replace({out}, '{word}', '{word[0]}\\{word[1:]}')"
    return out


SQL = {
    "op4_chat_format": f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = '{LEARNED}'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (role = '{LEARNED}'), '')) as loss_sha256,
  cast(sum(length({_sql_escaped("role")}) + length({_sql_escaped("text")}) + {len(OPEN + BODY + CLOSE)}) as bigint) as formatted_chars
from c group by conv_id""",
}
