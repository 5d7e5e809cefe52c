"""Chat formatting: typed content parts become one reversible string a conversation, by column expressions only.

A message has parts of kind text, image, audio or document.  The visitor turns
each part into text: a text part is escaped; any other becomes a placeholder
``<|kind turn.part|>``, its reference is recorded as an attachment, and its
units (image patches, audio frames, pages) expand to tokens at the template's
rate.  A turn is ``### role: `` + content + ``</turn>`` + newline.

Escaping, undone by dropping each backslash and keeping what follows it: ``\\``
is doubled, ``#`` gets a backslash before it, ``</turn>`` and ``<|`` get one
after ``<``, and in roles ``:`` gets one before it.  So no text can hold a
turn's end, a turn's start or a placeholder.

Rows are escaped where they are read; then one shuffle brings a conversation's
rows together, a running sum tells where each begins, and they are joined.  No
step takes longer than in proportion to the conversation, but for sorting it.

Null text, role or reference count as empty, null parts and unknown kinds give
nothing, null units count as 0.  Turns with the same number are ordered by
role and text; a null turn comes first.  A row with a null conv_id is a
conversation of its own.  Repeated rows stay.  Extra columns are not passed on.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

PARTS = "array<struct<kind:string,text:string,ref:string,units:bigint>>"


@dataclass(frozen=True)
class Template:
    """Control strings, roles under the loss mask, and tokens a unit of each kind of attachment."""

    start: str = "### "
    after_role: str = ": "
    end: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    rates: dict[str, int] = field(default_factory=lambda: {"image": 1, "audio": 25, "document": 400})


TEMPLATE = Template()


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, safe in (("#", "\\#"), ("</turn>", "<\\/turn>"), ("<|", "<\\|")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_parts(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as messages of one text part."""
    part = F.struct(F.lit("text").alias("kind"), F.col("text").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units"))
    return conversations.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def format_chat(messages: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """One row a conversation of messages (conv_id, turn, role, parts as in PARTS).

    conv_id, n_turns, formatted, loss_spans (start, length in code points of
    formatted: the content under the loss mask), loss (a flag for each turn),
    attachments (turn, part, kind, ref, tokens; in order), attachment_tokens.
    """
    kinds = list(template.rates)
    label = F.coalesce(F.col("turn").cast("string"), F.lit(""))
    visible = lambda p, i: F.when(p["kind"] == "text", escape(F.coalesce(p["text"], F.lit("")))).when(p["kind"].isin(kinds), F.concat(F.lit("<|"), p["kind"], F.lit(" "), label, F.lit("."), i.cast("string"), F.lit("|>"))).otherwise("")
    rate = F.create_map(*[F.lit(x) for kv in template.rates.items() for x in kv])
    attachment = lambda p, i: F.when(
        p["kind"].isin(kinds),
        F.struct(F.col("turn").cast("bigint").alias("turn"), i.cast("bigint").alias("part"), p["kind"].alias("kind"), F.coalesce(p["ref"], F.lit("")).alias("ref"), (F.coalesce(p["units"], F.lit(0)) * rate[p["kind"]]).cast("bigint").alias("tokens")),
    )
    role = F.coalesce("role", F.lit(""))
    parts = F.coalesce("parts", F.array().cast(PARTS))
    rows = messages.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"),
        F.concat(F.lit(template.start), F.replace(escape(role), F.lit(":"), F.lit("\\:")), F.lit(template.after_role)).alias("head"),
        F.concat_ws("", F.transform(parts, visible)).alias("body"),
        F.filter(F.transform(parts, attachment), lambda a: a.isNotNull()).alias("attachments"),
        role.isin(list(template.loss_roles)).alias("loss"),
    )
    end = F.lit(template.end)
    rows = rows.withColumn("alone", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))
    # Ties: the text as it was, not as it is escaped.
    inside = Window.partitionBy("conv_id", "alone").orderBy("turn", "role", unescape(F.col("body")), "body", F.col("attachments").cast("string"))
    size = F.length("head") + F.length("body") + F.length(end)
    placed = rows.select("*", F.row_number().over(inside).alias("n"), F.coalesce(F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("at"))
    span = F.struct((F.col("at") + F.length("head")).cast("bigint").alias("start"), F.length("body").cast("bigint").alias("length"))
    piece = F.struct("n", F.concat("head", "body", end).alias("text"), span.alias("span"), "loss", "attachments")
    whole = placed.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list(piece)).alias("t"))
    return whole.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda t: t["text"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda t: t["loss"]), lambda t: t["span"]).alias("loss_spans"),
        F.transform("t", lambda t: t["loss"]).alias("loss"), F.flatten(F.transform("t", lambda t: t["attachments"])).alias("attachments"),
    ).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda a, x: a + x["tokens"]))


def under_mask(formatted: Column, spans: Column) -> Column:
    """The texts that spans (start, length in code points, in order) of a formatted string hold, unescaped.

    Spans are taken in groups, as many as a group has spans, so that no
    substring is looked for from the beginning of a long string for each.
    """

    def groups(s: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(s))).cast("int")

        def of(g: Column) -> Column:
            first = F.get(g, F.lit(0))["start"].cast("int")
            last = F.element_at(g, -1)
            part = formatted.substr(first + 1, (last["start"] + last["length"]).cast("int") - first)
            return let(part, lambda p: F.transform(g, lambda x: unescape(p.substr(x["start"].cast("int") - first + 1, x["length"].cast("int")))))

        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(s), step), lambda i: let(F.slice(s, i, step), of)))

    return F.when(F.size(spans) > 0, let(spans, groups)).otherwise(F.array().cast("array<string>"))


def read_chat(formatted: Column, template: Template = TEMPLATE) -> Column:
    """The turns (role, text) that a formatted string holds, unescaped; placeholders stay as they are."""
    pieces = F.split(formatted, r"\Q" + template.end + r"\E")
    at = lambda p: F.instr(p, template.after_role)
    first, gap = len(template.start), len(template.after_role)
    return F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1),
        lambda p: F.struct(unescape(p.substr(F.lit(first + 1), at(p) - 1 - first)).alias("role"), unescape(p.substr(at(p) + gap, F.length(p))).alias("text")),
    )
