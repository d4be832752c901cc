"""Chat formatting as a grammar round trip, in DataFrame functions only.

Grammar of a formatted conversation::

    conversation := turn*
    turn         := "[INST]" role "[/INST]" text "</s>"

Role and text hold none of the three control strings. Reading a part back turns ``\\1``, ``\\2``, ``\\3``
into the control strings and ``\\0`` into a backslash. Every conversation is first rendered as it is,
parsed, and compared with its source. In one that differs, each part is rendered, read and compared on its
own, and those that conflict are escaped; the whole is then parsed and compared again. Should it still
differ, as it does if parts that are innocent alone make a control string together, all of its parts are
escaped; an escaped part holds no control string and no backslash without a digit, so the third reading
agrees, and a conversation whose reading does not raises an error rather than be written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
#: What an escaped part has for a backslash and the control strings; the backslash goes first.
ESCAPES = (("\\", "\\0"), (END, "\\1"), (OPEN, "\\2"), (CLOSE, "\\3"))


def escape(part: Column) -> Column:
    for plain, code in ESCAPES:
        part = F.replace(part, F.lit(plain), F.lit(code))
    return part


def unescape(part: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        part = F.replace(part, F.lit(code), F.lit(plain))
    return part


def render(turns: Column) -> Column:
    """Text of an array of (role, text)."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE), t["text"], F.lit(END))), "")


def escaped_turns(turns: Column, wrap) -> Column:
    """The turns with ``wrap`` applied to every part."""
    return F.transform(turns, lambda t: F.struct(wrap(t["role"]).alias("role"), wrap(t["text"]).alias("text")))


def escape_conflicting(part: Column) -> Column:
    """A part that reads back as itself stays; one that holds a control string or reads back as another text is escaped."""
    innocent = unescape(part) == part
    for control in (OPEN, CLOSE, END):
        innocent = innocent & ~F.contains(part, F.lit(control))
    return F.when(innocent, part).otherwise(escape(part))


def parse(formatted: Column) -> Column:
    """The array of (role, text) that a formatted text holds; null if it breaks the grammar."""

    def turn(piece: Column) -> Column:
        halves = F.split(piece, r"\[/INST\]", -1)
        body = F.get(halves, F.lit(1))
        # Exactly one "[/INST]", and exactly one "</s>", at the end.
        right = (F.size(halves) == 2) & (F.locate(END, piece) == F.length(piece) - len(END) + 1) & body.endswith(END)
        return F.when(
            right,
            F.struct(unescape(F.get(halves, F.lit(0))).alias("role"), unescape(F.substring(body, F.lit(1), F.length(body) - len(END))).alias("text")),
        )

    pieces = F.split(formatted, r"\[INST\]", -1)
    turns = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)
    whole = (F.get(pieces, F.lit(0)) == "") & ~F.exists(turns, lambda t: t.isNull())
    return F.when(whole, turns)


def format_chat(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_roles: Sequence[str] = ("assistant",),
) -> DataFrame:
    """Format conversations given one row per turn.

    Returns one row per conversation: ``conv_id``, ``formatted``, ``escaped`` (whether its parts had to
    be), and ``loss_mask``: runs of (masked, n_chars) that cover ``formatted`` from its first code point
    to its last; masked are the texts of ``loss_roles``.

    Turns go by turn number, nulls first, ties by role, then text; repeated rows are repeated turns. A
    null text or role counts as empty; a null conversation id is a conversation of its own. An empty
    table gives an empty result. Other columns are not read. A conversation is one value of the result,
    so its turns do meet in one task.
    """
    turns = (
        rows.groupBy(F.col(conv_col).alias("conv_id"))
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        F.col(turn_col).isNotNull().alias("numbered"),
                        F.coalesce(F.col(turn_col), F.lit(0)).alias("turn"),
                        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                    )
                )
            ).alias("turns")
        )
        .withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    )
    turns_ = F.col("turns")

    def reads_back(parts: str) -> Column:
        return F.coalesce(parse(render(F.col(parts))) == turns_, F.lit(False))

    # Rendered, read and compared up to three times; most conversations pass the first.
    once = turns.withColumn("plain", reads_back("turns"))
    once = once.withColumn("parts", F.when(F.col("plain"), turns_).otherwise(escaped_turns(turns_, escape_conflicting)))
    again = once.withColumn("agrees", F.when(F.col("plain"), F.lit(True)).otherwise(reads_back("parts")))
    again = again.withColumn("parts", F.when(F.col("agrees"), F.col("parts")).otherwise(escaped_turns(turns_, escape)))
    last = again.withColumn("formatted", render(F.col("parts")))
    agrees = F.col("agrees") | F.coalesce(parse(F.col("formatted")) == turns_, F.lit(False))
    formatted = F.when(agrees, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not read back as it was")))

    def runs(t: Column) -> Column:
        head = F.length(t["role"]) + len(OPEN) + len(CLOSE)
        lengths = ((F.lit(False), head), (unescape(t["role"]).isin(*loss_roles), F.length(t["text"])), (F.lit(False), F.lit(len(END))))
        return F.array(*[F.struct(m.alias("masked"), n.cast("long").alias("n_chars")) for m, n in lengths])

    return last.select("conv_id", formatted.alias("formatted"), (~F.col("plain")).alias("escaped"), F.flatten(F.transform("parts", runs)).alias("loss_mask"))


def masked_texts(formatted: Column, loss_mask: Column) -> Column:
    """The pieces of a formatted text under its loss mask, read back: what its runs cut out, unescaped."""
    none = F.array().cast("array<struct<at:bigint,n:bigint>>")

    def step(acc: Column, run: Column) -> Column:
        cut = F.array(F.struct(acc["at"].alias("at"), run["n_chars"].alias("n")))
        return F.struct((acc["at"] + run["n_chars"]).alias("at"), F.when(run["masked"], F.concat(acc["cuts"], cut)).otherwise(acc["cuts"]).alias("cuts"))

    cuts = F.aggregate(loss_mask, F.struct(F.lit(0).cast("long").alias("at"), none.alias("cuts")), step)["cuts"]
    chars = F.split(formatted, "", -1)  # so that a cut costs its own length, not its distance from the start
    both = F.struct(chars.alias("chars"), cuts.alias("cuts"))  # named, so that the split is made once
    return F.transform(
        F.array(both),
        lambda w: F.transform(w["cuts"], lambda c: unescape(F.array_join(F.slice(w["chars"], (c["at"] + 1).cast("int"), c["n"].cast("int")), ""))),
    )[0]


def op9_chat(spark, sf_dir: str) -> DataFrame:
    """Digests, read back from the formatted text, of the whole of ``conversations`` and one hard case."""
    hard = spark.sql(
        "SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]')"
        " AS t(conv_id, turn, role, text)"
    )
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(hard)
    back = format_chat(rows).withColumn("turns", parse(F.col("formatted")))
    loss = F.array_join(masked_texts(F.col("formatted"), F.col("loss_mask")), "")
    return (
        back.withColumn("loss", loss)
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


OP9_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, CASE WHEN regexp_matches(role, '</s>|\[/?INST\]|\\[0-3]') THEN role ELSE '' END
            || ' ' || CASE WHEN regexp_matches(text, '</s>|\[/?INST\]|\\[0-3]') THEN text ELSE '' END AS hard
  FROM rows
), sized AS (
  SELECT *, length(role) + length(text) + 17
      + len(regexp_extract_all(hard, '\\')) - 2 * len(regexp_extract_all(hard, '</s>'))
      - 4 * len(regexp_extract_all(hard, '\[INST\]')) - 5 * len(regexp_extract_all(hard, '\[/INST\]')) AS n
  FROM marked
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
