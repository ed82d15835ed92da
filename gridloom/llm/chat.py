"""Chat formatting, in DataFrame operations only.

A turn's content is an ordered list of typed parts: text, image, audio and document. A visitor over the
parts writes texts (escaped) and one placeholder for each attachment, and records the attachment's
reference, its place and how many tokens it expands to. The template marks turns:

    [TURN]role[SAYS]content[END]

``&``, ``[`` and ``<`` inside roles and texts are escaped, so no text can forge a mark, and reading back gives the
texts again. The loss mask covers the content of assistant turns: spans of code points, without marks.

Defined results: null text is empty and a null role is an empty role; turns are in order of turn (null
first), ties by role, then by the text as it was before escaping; repeated rows are repeated turns; conversations without an id form one.
One output row holds a whole conversation, as its format demands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.native import blocks, let, part, sums

#: Tokens that an attachment without a count of its own expands to.
EXPANDS = {"image": 256, "audio": 128, "document": 512}
PART = "struct<type:string,text:string,ref:string,tokens:int>"
ESCAPES = (("&", "&amp;"), ("[", "&#91;"), ("<", "&lt;"))


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def text_parts(text: Column) -> Column:
    """A plain text as a list of parts."""
    none = F.lit(None).cast("string")
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), none.alias("ref"), F.lit(None).cast("int").alias("tokens")))


def _visit(part: Column) -> Column:
    """What a part becomes in the output."""
    return F.when(part["type"] == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<"), escape(F.coalesce(part["type"], F.lit("unknown"))), F.lit(">")))


def _expanded(part: Column) -> Column:
    usual = F.lit(1)
    for kind, n in EXPANDS.items():
        usual = F.when(part["type"] == kind, n).otherwise(usual)
    return F.coalesce(part["tokens"], usual)


def format_chats(turns: DataFrame) -> DataFrame:
    """turns: conv_id, turn, role, parts. Returns conv_id, formatted, mask (array of start and end), attachments.

    attachments: array of (turn number, place in formatted, type, ref, tokens) in order.
    """
    role = F.coalesce("role", F.lit(""))
    body = F.array_join(F.transform("parts", _visit), "")
    plain = F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], p["ref"], F.lit(""))), "")
    files = F.filter("parts", lambda p: p["type"] != "text")
    turn = F.struct("turn", role.alias("role"), plain.alias("plain"), body.alias("body"), F.transform(files, lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), _expanded(p).alias("tokens"))).alias("files"))
    rows = turns.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    head = lambda x: F.concat(F.lit("[TURN]"), escape(x["role"]), F.lit("[SAYS]"))
    sizes = F.transform("t", lambda x: F.struct(F.length(head(x)).alias("head"), F.length(x["body"]).alias("body"), (x["role"] == "assistant").alias("loss")))
    said = rows.select("conv_id", "t", sizes.alias("sizes"))
    # Where turns end: running sums of their lengths, [END] included.
    ends = sums(F.transform("sizes", lambda x: x["head"] + x["body"] + 5))
    said = said.select("conv_id", "t", "sizes", ends.alias("ends"))
    places = F.zip_with("sizes", "ends", lambda x, e: F.struct((e - 5 - x["body"]).alias("start"), (e - 5).alias("end"), x["loss"].alias("loss")))
    whole = F.array_join(F.transform("t", lambda x: F.concat(head(x), x["body"], F.lit("[END]"))), "")
    made = said.select("conv_id", "t", whole.alias("formatted"), places.alias("places"))
    attachments = F.flatten(F.transform("t", lambda x, i: F.transform(x["files"], lambda f: F.struct(i.alias("turn"), F.get("places", i)["start"].alias("place"), f["type"].alias("type"), f["ref"].alias("ref"), f["tokens"].alias("tokens")))))
    mask = F.transform(F.filter("places", lambda p: p["loss"] & (p["end"] > p["start"])), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")))
    return made.select("conv_id", "formatted", mask.alias("mask"), attachments.alias("attachments"))


def read_back(formatted: Column) -> Column:
    """array of (role, text) from a formatted conversation of texts."""
    turns = F.filter(F.split(formatted, r"\[END\]", -1), lambda x: x != "")
    return F.transform(turns, lambda x: F.struct(unescape(F.substring_index(F.substring(x, 7, 1 << 30), "[SAYS]", 1)).alias("role"), unescape(F.substring_index(x, "[SAYS]", -1)).alias("text")))


def under_mask(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, in order."""
    return unescape(let(blocks(formatted), lambda cut: F.array_join(F.transform(mask, lambda m: part(cut, m["start"], m["end"])), "")))
