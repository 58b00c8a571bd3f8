"""Operator 10, chat formatting: a grammar round trip in DataFrame functions only.

Every turn is rendered by the template, the rendered text is parsed again by the same grammar, and the recovered turn is
compared with its source. A turn that does not come back identical, or holds a control string, is rendered again at the
next level of escaping, and parsed again; what differs even then is an error. The parser needs no level: it undoes escapes,
which plain turns do not hold.

    output := turn*        turn := "<|im_start|>" role "\\n" text "<|im_end|>" "\\n"
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Strings that must not stand in a rendered text: the template's own, and those of templates that other readers know.
CONTROL = (OPEN, CLOSE, "<|endoftext|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>")
#: What escapes put in the place of a control string's first character, of a line feed in a role, and last of ``&``.
ESCAPES = (("<", "&lt;"), ("[", "&#91;"), ("\n", "&#10;"), ("&", "&amp;"))


def _any_of(strings: tuple[str, ...]) -> str:
    quoted = [reduce(lambda s, c: s.replace(c, "\\" + c), r"[]()|<>/", s) for s in strings]
    return "|".join(quoted)


def escape(text: Column, level: int, role: bool = False) -> Column:
    """Level 0 leaves the text, level 1 escapes ``&`` and control strings, and line feeds in roles."""
    if level == 0:
        return text
    text = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for control in CONTROL:
        shut = dict(ESCAPES)[control[0]] + control[1:]
        text = F.replace(text, F.lit(control), F.lit(shut))
    return F.replace(text, F.lit("\n"), F.lit("&#10;")) if role else text


def unescape(text: Column) -> Column:
    """The inverse of ``escape`` at any level, for texts whose round trip holds."""
    return reduce(lambda t, e: F.replace(t, F.lit(e[1]), F.lit(e[0])), ESCAPES, text)


def parse(formatted: Column) -> Column:
    """The turns (role, text, raw) of formatted text; ``raw`` is the text as it stands."""
    shut = F.split(formatted, _any_of((CLOSE,)) + "\n")
    bodies = F.slice(shut, 1, F.size(shut) - 1)

    def turn(body: Column) -> Column:
        head = F.instr(body, "\n")
        raw = F.substring(body, head + 1, F.length(body))
        role = F.substring(body, F.lit(len(OPEN) + 1), head - 1 - len(OPEN))
        return F.struct(unescape(role).alias("role"), unescape(raw).alias("text"), raw.alias("raw"))

    return F.transform(bodies, turn)


def _render(role: Column, text: Column, level: int) -> Column:
    return F.concat(F.lit(OPEN), escape(role, level, role=True), F.lit("\n"), escape(text, level), F.lit(CLOSE + "\n"))


def _holds(role: Column, text: Column, level: int) -> Column:
    """Whether the turn, rendered at the level, parses to exactly itself and holds no control string."""
    back = parse(_render(role, text, level))
    same = (F.size(back) == 1) & (back[0]["role"] == role) & (back[0]["text"] == text)
    inner = F.concat(escape(role, level, role=True), F.lit("\n"), escape(text, level))
    return same & ~inner.rlike(_any_of(CONTROL))


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, n_escaped, loss_spans (start from 1, length; in code points).

    ``turns`` has conv_id, turn, role, text; other columns are not read. Null roles and texts count as empty. Turns are
    ordered by turn (nulls first), then role, then text; repeated rows stay. Rows of null conv_id are one conversation.
    An empty table gives an empty table. A conversation is one output value, so it must fit one task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    level = F.when(_holds(F.col("role"), F.col("text"), 0), 0).when(_holds(F.col("role"), F.col("text"), 1), 1).otherwise(F.raise_error(F.lit("a turn does not come back from its rendering")).cast("int"))
    rows = rows.withColumn("_level", level)
    out = F.when(F.col("_level") == 0, _render(F.col("role"), F.col("text"), 0)).otherwise(_render(F.col("role"), F.col("text"), 1))
    body = F.when(F.col("_level") == 0, F.col("text")).otherwise(escape(F.col("text"), 1))
    rows = rows.select("conv_id", "turn", "role", "text", out.alias("_out"), F.length(body).alias("_body"), "_level")
    # where each turn ends; the sum runs once over a conversation's turns
    turns_so_far = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_after", F.sum(F.length("_out")).over(turns_so_far).cast("int"))
    shut = len(CLOSE) + 1
    span = F.when(F.col("role") == loss_role, F.struct((F.col("_after") - shut - F.col("_body") + 1).alias("start"), F.col("_body").alias("length")))
    chats = rows.select("conv_id", F.struct("_after", F.col("_out").alias("out"), span.alias("span"), F.col("_level").alias("level")).alias("_turn"))
    chats = chats.groupBy("conv_id").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    return chats.select(
        "conv_id",
        F.array_join(F.transform("_turns", lambda t: t["out"]), "").alias("formatted"),
        F.aggregate("_turns", F.lit(0), lambda n, t: n + t["level"]).alias("n_escaped"),
        F.filter(F.transform("_turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """Digests of formatted conversations, from the formatted text and its spans alone."""
    turns = parse(F.col("formatted"))
    told = F.array_join(F.transform("_back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"], s["length"]))), "")
    return (
        chats.withColumn("_back", turns)
        .withColumn("_loss", loss)
        .select(
            "conv_id",
            F.size("_back").cast("long").alias("n_turns"),
            F.sha2(told, 256).alias("turns_sha256"),
            F.length("_loss").cast("long").alias("loss_chars"),
            F.sha2("_loss", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


def oracle_sql(loss_role: str = "assistant") -> str:
    """DuckDB SQL for the digests of ``conversations`` and one more, taken from the source; lengths follow the template."""
    replaced = lambda text, pairs: reduce(lambda t, p: f"replace({t}, {p[0]}, {p[1]})", pairs, text)
    sql = lambda c: "chr(10)" if c == "\n" else f"'{c}'"
    shut = [("'&'", "'&amp;'"), *((f"'{c}'", f"'{dict(ESCAPES)[c[0]] + c[1:]}'") for c in CONTROL)]
    opened = [(f"'{e}'", sql(c)) for c, e in ESCAPES]
    held = " OR ".join(f"contains(role || chr(10) || text, '{c}')" for c in CONTROL)
    odd = f"{held} OR contains(role, chr(10)) OR {replaced('text', opened)} <> text OR {replaced('role', opened)} <> role"
    escaped = f"CASE WHEN odd THEN {replaced('text', shut)} ELSE text END"
    role = f"CASE WHEN odd THEN {replaced('role', [*shut, ('chr(10)', chr(39) + '&#10;' + chr(39))])} ELSE role END"
    return f"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
    o AS (SELECT *, ({odd}) AS odd FROM t),
    f AS (SELECT *, {len(OPEN) + len(CLOSE) + 2} + length({role}) + length({escaped}) AS n FROM o),
    g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{loss_role}'), '') AS loss, sum(n) AS chars FROM f GROUP BY 1)
    SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g
    """
