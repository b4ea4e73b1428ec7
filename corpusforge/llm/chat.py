"""Chat formatting by grammar round trip (DataFrame functions only).

A conversation is rendered with a marked template, lexed and reparsed by a
deterministic parser, and the recovered turns are compared with the source.
Conversations that come back different are rendered again with more escaping,
until they are identical:

* level 0: no text is escaped;
* level 1: texts that hold a control string are escaped;
* level 2: every text is escaped;
* a conversation that differs even then raises (never a silent loss).

Template: ``[INST]user[/INST]``, ``<s>assistant</s>``, ``<<SYS>>system<</SYS>>``
and ``<<ROLE hex>>text<</ROLE>>`` for any other role (hex of its UTF-8 name).
An escaped text has its backslashes doubled and a backslash after the first
character of each control string; its opening mark says so (``[INST\\]``,
``<s\\>``, ``<<SYS\\>>``, ``<<ROLE\\ hex>>``).

Defined results: null role or text is empty; rows are ordered by turn (null
first), then role, then text; repeated rows are repeated turns; a null conv_id
is one conversation; an empty table gives an empty result; other columns, clashing
names included, are not read. Ties in turn, role and text are equal turns. A very
long text is escaped, lexed and cut in a few linear passes. One conversation is
one formatted text, so its turns meet in one row by definition of the output;
escaping work does not repeat for conversations that are identical at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"\[/?INST\\?\]|</?s\\?>|<</?SYS\\?>>|<</?ROLE\\?(?: [0-9A-F]*)?>>"
#: Characters of a block and turns of a chunk, when the loss mask is cut out of a text.
BLOCK, CHUNK = 2048, 512
_BREAK = r"\[(?=/?INST\\?\])|<(?=/?s\\?>|</?SYS\\?>>|</?ROLE\\?(?: [0-9A-F]*)?>>)"


def escape(text: Column) -> Column:
    """Double backslashes, then break each control string after its first character."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, F.lit(_BREAK), F.lit(r"$0\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once: inside lambdas a plain column is computed at each mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _marks(role: Column, escaped: Column) -> tuple[Column, Column]:
    bs = F.when(escaped, F.lit("\\")).otherwise(F.lit(""))
    opened = (F.when(role == "user", F.concat(F.lit("[INST"), bs, F.lit("]")))
              .when(role == "assistant", F.concat(F.lit("<s"), bs, F.lit(">")))
              .when(role == "system", F.concat(F.lit("<<SYS"), bs, F.lit(">>")))
              .otherwise(F.concat(F.lit("<<ROLE"), bs, F.lit(" "), F.hex(role), F.lit(">>"))))
    closed = (F.when(role == "user", F.lit("[/INST]"))
              .when(role == "assistant", F.lit("</s>"))
              .when(role == "system", F.lit("<</SYS>>"))
              .otherwise(F.lit("<</ROLE>>")))
    return opened, closed


def render(turns: Column, level: int) -> Column:
    """Formatted text of an array of (role, text) turns at an escape level."""
    def one(t):
        if level == 0:
            esc = F.lit(False)
        elif level == 1:
            esc = t["text"].rlike(CONTROL)
        else:
            esc = F.lit(True)
        def put(e):
            opened, closed = _marks(t["role"], e)
            return F.concat(opened, F.when(e, escape(t["text"])).otherwise(t["text"]), closed)
        return _let(esc, put)
    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """Turns of a formatted text; null where it does not follow the grammar.

    The lexer cuts the text at control strings; the grammar wants an opening
    mark, one text, the matching closing mark, and nothing between turns.
    """
    def kind(m):
        return F.regexp_extract(m, r"^(\[|<<SYS|<<ROLE|<s)", 1)

    def turns_of(lexed):
        marks, segs = lexed["marks"], lexed["segs"]

        def turn(i):
            return _let(F.struct(F.get(marks, i * 2).alias("opened"), F.get(marks, i * 2 + 1).alias("closed"),
                                 F.get(segs, i * 2 + 1).alias("text"), F.get(segs, i * 2 + 2).alias("gap"),
                                 kind(F.get(marks, i * 2)).alias("kind")), one)

        def one(t):
            role = (F.when(t["kind"] == "[", F.lit("user")).when(t["kind"] == "<s", F.lit("assistant"))
                    .when(t["kind"] == "<<SYS", F.lit("system"))
                    .when(t["kind"] == "<<ROLE", F.decode(F.unhex(F.regexp_extract(t["opened"], r" ([0-9A-F]*)>>$", 1)), "UTF-8")))
            want = (F.when(t["kind"] == "[", F.lit("[/INST]")).when(t["kind"] == "<s", F.lit("</s>"))
                    .when(t["kind"] == "<<SYS", F.lit("<</SYS>>")).when(t["kind"] == "<<ROLE", F.lit("<</ROLE>>")))
            return F.when((t["closed"] == want) & (t["gap"] == ""),
                          F.struct(role.alias("role"), F.when(t["opened"].contains("\\"), unescape(t["text"]))
                                   .otherwise(t["text"]).alias("text")))

        n = F.size(marks)
        return F.when((n > 0) & (n % 2 == 0) & (F.get(segs, F.lit(0)) == ""),
                      F.transform(F.sequence(F.lit(0), F.floor(n / 2).cast("int") - 1), turn))

    turns = _let(F.struct(F.regexp_extract_all(formatted, F.lit(CONTROL), F.lit(0)).alias("marks"),
                          F.split(formatted, CONTROL, -1).alias("segs")), turns_of)
    return _let(turns, lambda ts: F.when(~F.exists(ts, lambda t: t.isNull()), ts))


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns, formatted, level, layout): one formatted text per conversation.

    ``layout`` is the loss mask as runs: per turn its characters in ``formatted``,
    whether it bears loss, whether its text is escaped, and the run of assistant
    text in it (``loss_from``, ``loss_chars``).
    """
    empty = F.lit("")
    t = (rows.select(F.col(conv).alias("conv_id"),
                     F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), empty).alias("role"),
                              F.coalesce(F.col(text).cast("string"), empty).alias("text")).alias("t"))
         .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
         .select("conv_id", F.transform("ts", lambda x: F.struct(x["role"].alias("role"),
                                                                 x["text"].alias("text"))).alias("turns")))
    turns = F.col("turns")

    def back(level):
        return F.coalesce(parse(F.col(f"f{level}")) == turns, F.lit(False))

    t = t.withColumn("f0", render(turns, 0)).withColumn("ok0", back(0))
    t = t.withColumn("f1", F.when(~F.col("ok0"), render(turns, 1))).withColumn("ok1", back(1))
    t = t.withColumn("f2", F.when(~F.col("ok0") & ~F.col("ok1"), render(turns, 2))).withColumn("ok2", back(2))
    t = t.select("conv_id", "turns",
                 F.when(F.col("ok0"), F.col("f0")).when(F.col("ok1"), F.col("f1")).when(F.col("ok2"), F.col("f2"))
                 .otherwise(F.raise_error(F.lit("a conversation does not survive the round trip"))).alias("formatted"),
                 F.when(F.col("ok0"), 0).when(F.col("ok1"), 1).otherwise(2).alias("level"))

    def run(x):
        esc = F.when(F.col("level") == 0, F.lit(False)).when(F.col("level") == 2, F.lit(True)).otherwise(
            x["text"].rlike(CONTROL))
        opened, closed = _marks(x["role"], esc)
        body = F.length(F.when(esc, escape(x["text"])).otherwise(x["text"]))
        loss = x["role"] == "assistant"
        return F.struct((F.length(opened) + body + F.length(closed)).alias("chars"),
                        loss.alias("loss"), esc.alias("escaped"),
                        F.when(loss, F.length(opened)).otherwise(F.lit(0)).alias("loss_from"),
                        F.when(loss, body).otherwise(F.lit(0)).alias("loss_chars"))
    return t.withColumn("layout", F.transform("turns", run))


def _running(lens: Column, start: Column) -> Column:
    """``start`` and its running totals with each of ``lens``: one entry more than ``lens``."""
    return F.aggregate(lens, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def starts(lens: Column) -> Column:
    """Sum of the lengths before each entry, by totals of chunks, so a long list costs little more than its length."""
    zero = F.lit(0).cast("long")
    chunks = F.transform(F.sequence(F.lit(0), F.floor(F.size(lens) / CHUNK).cast("int")),
                         lambda c: F.slice(lens, c * CHUNK + 1, CHUNK))

    def within(x):
        return F.flatten(F.transform(x["chunks"], lambda chunk, c: F.slice(
            _running(chunk, F.get(x["bases"], c)), F.lit(1), F.size(chunk))))

    def based(parts):
        sums = F.transform(parts, lambda chunk: F.aggregate(chunk, zero, lambda acc, x: acc + x))
        return _let(F.struct(parts.alias("chunks"), _running(sums, zero).alias("bases")), within)

    return _let(chunks, based)


def masked(formatted: Column, layout: Column) -> Column:
    """Texts under the loss mask, unescaped, in order: runs cut out of ``formatted`` at the layout's offsets.

    A run is cut out of the few blocks of ``BLOCK`` characters that it lies in,
    so no cut walks the whole text.
    """
    def cut(x):
        def one(at, i):
            def body(r):
                begin = (at + r["loss_from"]).cast("long")
                block = F.floor(begin / BLOCK).cast("int")
                last = F.floor((begin + r["loss_chars"]) / BLOCK).cast("int")
                near = F.array_join(F.slice(x["blocks"], block + 1, last - block + 1), "")
                raw = F.substring(near, (begin - block * BLOCK + 1).cast("int"), r["loss_chars"])
                return F.when(r["loss"], F.when(r["escaped"], unescape(raw)).otherwise(raw))
            return _let(F.get(x["layout"], i), body)
        return F.filter(F.transform(x["starts"], one), lambda t: t.isNotNull())

    blocks = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return _let(F.struct(blocks.alias("blocks"), layout.alias("layout"),
                         starts(F.transform(layout, lambda r: r["chars"].cast("long"))).alias("starts")), cut)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests taken from the output alone: turns are reparsed, loss texts are cut out by the mask.

    A mask whose texts are not those of the reparsed assistant turns raises.
    """
    t = formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("got"),
                         masked(F.col("formatted"), F.col("layout")).alias("loss"))
    whole = F.array_join(F.transform("got", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    parsed = F.transform(F.filter("got", lambda x: x["role"] == "assistant"), lambda x: x["text"])
    t = t.withColumn("turns", whole).withColumn("loss", F.when(F.col("loss") == parsed, F.array_join("loss", "")).otherwise(
        F.raise_error(F.lit("the loss mask does not cover the assistant turns"))))
    return t.select("conv_id", F.size("got").cast("long").alias("n_turns"),
                    F.sha2(F.col("turns"), 256).alias("turns_sha256"),
                    F.length("loss").cast("long").alias("loss_chars"),
                    F.sha2(F.col("loss"), 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars"))
