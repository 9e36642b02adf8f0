r"""Chat formatting of typed content parts.

A turn holds parts: text, images, audio, documents. A visitor turns each part into what
stands in the output, an escaped text or a placeholder, and into an attachment: its kind,
its reference and the number of tokens that a model puts in the placeholder's place. The
n-th placeholder of a conversation belongs to its n-th attachment.

Control strings all begin with ``<`` or ``[`` and hold neither after that. Where a text
has one, with any number of backslashes after its first character, escaping adds one
backslash there and unescaping takes one away, so every text comes back as it was, and no
control string stands in the output but those that the template put there.

Turns are rendered where they are read. One shuffle brings those of a conversation
together; the conversation is one value, so its size is bounded by that of a Spark string.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm.bind import bind

PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
ATTACHMENT = "struct<kind:string,ref:string,tokens:bigint>"

BEGIN, ROLE_END, TURN_END = "<s>[INST]", "[/INST]", "</s>"
TAILS = r"(s>|/s>|INST\]|/INST\]|image>|audio>|document>)"
PLAIN, ESCAPED = rf"([<\[])(\\*){TAILS}", rf"([<\[])\\(\\*){TAILS}"


@dataclass(frozen=True)
class Chat:
    """Roles whose texts are learned, and what an attachment expands to.

    An image has one token per ``patch`` x ``patch`` pixels, parts of one counted whole;
    audio ``per_second``, rounded up; a document ``per_page``. Sizes that are null count as 0.
    """

    learned: tuple[str, ...] = ("assistant",)
    patch: int = 28
    per_second: float = 25.0
    per_page: int = 1024


DEFAULT = Chat()


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, PLAIN, r"$1$2\\$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


class Visitor:
    """What each kind of part becomes; a kind without a method here is a text."""

    def __init__(self, how: Chat):
        self.how = how

    def text(self, part: Column) -> Column:
        return escaped(F.coalesce(part.text, F.lit("")))

    def image(self, part: Column) -> Column:
        across, down = F.ceil(part.width / self.how.patch), F.ceil(part.height / self.how.patch)
        return across * down

    def audio(self, part: Column) -> Column:
        return F.ceil(part.seconds * self.how.per_second)

    def document(self, part: Column) -> Column:
        return part.pages * F.lit(self.how.per_page)

    KINDS = ("image", "audio", "document")

    def shown(self, part: Column) -> Column:
        """The part in the output."""
        placeholder = F.concat(F.lit("<"), part.kind, F.lit(">"))
        return F.when(part.kind.isin(*self.KINDS), placeholder).otherwise(self.text(part))

    def attachment(self, part: Column) -> Column:
        """Null for a text."""
        tokens = F.lit(None).cast("bigint")
        for kind in self.KINDS:
            tokens = F.when(part.kind == kind, F.coalesce(getattr(self, kind)(part).cast("bigint"), F.lit(0))).otherwise(tokens)
        named = F.struct(part.kind.alias("kind"), part.ref.alias("ref"), tokens.alias("tokens"))
        return F.when(part.kind.isin(*self.KINDS), named)


def text_parts(text: Column) -> Column:
    """A text as the only part of its turn; a null text is empty."""
    none = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    blank = [F.lit(None).cast(t).alias(name) for name, t in none.items()]
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), *blank)).cast(PARTS)


def format_turns(rows: DataFrame, how: Chat = DEFAULT) -> DataFrame:
    """conv_id, turn, head, body, learned, attachments: one row per row, nothing shuffled.

    ``rows`` has conv_id, turn, role and ``parts`` (``PARTS``). Null parts are none, a null
    role is an empty one; other columns are ignored.
    """
    visitor = Visitor(how)
    parts, role = F.coalesce("parts", F.array().cast(PARTS)), F.coalesce("role", F.lit(""))
    attached = F.filter(F.transform(parts, visitor.attachment), lambda a: a.isNotNull())
    return rows.select(
        "conv_id", "turn", F.concat(F.lit(BEGIN), escaped(role), F.lit(ROLE_END)).alias("head"),
        F.array_join(F.transform(parts, visitor.shown), "").alias("body"),
        role.isin(*how.learned).alias("learned"), attached.cast(f"array<{ATTACHMENT}>").alias("attachments"),
    )


def format_conversations(rows: DataFrame, how: Chat = DEFAULT) -> DataFrame:
    """conv_id, formatted, turns, attachments, media_tokens: one row per conv_id, null included.

    ``turns`` has for each turn, in order, where it starts, where its body starts and ends,
    in code points of ``formatted``, and whether the body is learned: the loss mask. Turns
    come by ``turn``, nulls first; rows of one turn by role and body, so repeated rows are
    turns of their own. No rows give no conversations.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "head", "body")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = format_turns(rows, how).withColumns({"in_head": F.length("head").cast("bigint"), "in_body": F.length("body").cast("bigint")})
    turns = turns.withColumns(
        {"place": F.row_number().over(order), "upto": F.sum(F.col("in_head") + F.col("in_body") + len(TURN_END)).over(so_far)}
    )
    end = F.col("upto") - len(TURN_END)
    body = end - F.col("in_body")
    one = F.struct(
        "place", F.concat("head", "body", F.lit(TURN_END)).alias("text"), "attachments",
        F.struct((body - F.col("in_head")).alias("start"), body.alias("body"), end.alias("end"), "learned").alias("span"),
    )
    # by place first, so sorting compares numbers only
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("in_order"))
    attachments = F.flatten(F.col("in_order.attachments"))
    return whole.select(
        "conv_id", F.array_join(F.col("in_order.text"), "").alias("formatted"), F.col("in_order.span").alias("turns"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("bigint"), lambda sum_, a: sum_ + a.tokens).alias("media_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The rows with roles, texts and learned_texts, from the output and its loss mask alone.

    Texts have their placeholders in them. ``learned_texts`` is what the mask covers, cut
    by its numbers, then unescaped.
    """
    pieces = F.split("formatted", TURN_END)  # the last is the empty rest
    cut = bind(formatted, pieces=pieces)
    cut = cut.withColumn("pieces", F.slice("pieces", F.lit(1), F.size("pieces") - 1))
    cut = bind(cut, fields=F.transform("pieces", lambda p: F.split(p, r"<s>\[INST\]|\[/INST\]")))
    covered = F.zip_with(
        "pieces", "turns",
        lambda p, t: F.when(t.learned, F.substr(p, (t.body - t.start + 1).cast("int"), (t.end - t.body).cast("int"))),
    )
    return cut.select(
        *formatted.columns, F.transform("fields", lambda f: unescaped(f[1])).alias("roles"),
        F.transform("fields", lambda f: unescaped(f[2])).alias("texts"),
        F.transform(F.filter(covered, lambda c: c.isNotNull()), unescaped).alias("learned_texts"),
    )
