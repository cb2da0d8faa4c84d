"""Chat formatting: a finite-state machine over roles and a declarative template.

Only DataFrame functions; one conversation is one row from its first shuffle on.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around turns, the strings that texts may not contain as such, and the order of roles."""

    before_role: str = "<|"
    after_role: str = "|>\n"
    close: str = "</s>\n"
    controls: tuple[str, ...] = ("<s>", "</s>", "<|", "|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    learned: tuple[str, ...] = ("assistant",)
    turns: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})


DEFAULT = Template()


def escape(text: Column, template: Template) -> Column:
    """No control string is left: a backslash becomes ``\\b``, and ``\\e`` parts each
    control string after its first character. Every backslash is followed by b or e,
    so ``unescape`` gives back any text."""
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    for c in template.controls:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\e{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\e"), F.lit("")), F.lit("\\b"), F.lit("\\"))


def final_state(roles: Column, template: Template) -> Column:
    """The machine's state after all roles; ``invalid`` once a turn is out of order."""
    moves = F.create_map(*[F.lit(x) for state, after in template.turns.items() for to in after for x in (f"{state}>{to}", to)])
    return F.aggregate(roles, F.lit("start"), lambda state, role: F.coalesce(F.try_element_at(moves, F.concat(state, F.lit(">"), role)), F.lit("invalid")))


def format_chats(turns: DataFrame, template: Template = DEFAULT, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, state, valid, segments, formatted) of each conversation.

    ``segments`` are (text, loss) pieces in order, whose concatenation is ``formatted``.
    Turns are ordered by turn, then role and text, nulls first; repeated rows are turns
    of their own. Null texts and roles count as empty; an empty role is out of order.
    Turns out of order are formatted and told by ``valid``, not dropped. Rows with a
    null conversation are one conversation. Other columns are not read. No rows give
    no rows.
    """
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    one = turns.select(F.col(conv_col).alias("conv"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).alias("turn"))
    rows = one.groupBy("conv").agg(F.array_sort(F.collect_list("turn")).alias("turns"))

    def pieces(t: Column) -> Column:
        mark = F.concat(F.lit(template.before_role), escape(t["role"], template), F.lit(template.after_role))
        loss = t["role"].isin(*template.learned)
        return F.array(
            F.struct(mark.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"], template).alias("text"), loss.alias("loss")),
            F.struct(F.lit(template.close).alias("text"), F.lit(False).alias("loss")),
        )

    state = final_state(F.col("turns.role"), template)
    rows = rows.select(F.col("conv").alias(conv_col), state.alias("state"), F.flatten(F.transform("turns", pieces)).alias("segments"))
    return rows.select(conv_col, "state", (F.col("state") != "invalid").alias("valid"), "segments", F.array_join(F.col("segments.text"), "").alias("formatted"))


def read_back(formatted: Column, template: Template = DEFAULT) -> Column:
    """The turns (role, text) that a formatted conversation holds."""

    def turn(part: Column) -> Column:
        at = F.instr(part, template.after_role)
        role = F.substring(part, F.lit(len(template.before_role) + 1), at - 1 - len(template.before_role))
        text = F.substring(part, at + len(template.after_role), F.length(part))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    parts = F.split(formatted, F.lit("\\Q" + template.close + "\\E"))
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def digest(chats: DataFrame, template: Template = DEFAULT, conv_col: str = "conv_id") -> DataFrame:
    """Counts and digests of each conversation, from its formatted text and segments."""
    said = chats.select("*", read_back(F.col("formatted"), template).alias("said"), F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "").alias("learned"))
    every = F.array_join(F.transform("said", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return said.select(
        conv_col,
        F.size("said").cast("long").alias("n_turns"),
        F.sha2(every.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def oracle_sql(template: Template = DEFAULT) -> str:
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"

    def escaped(c: str) -> str:
        c = f"replace({c}, '\\', '\\b')"
        for x in template.controls:
            c = f"replace({c}, {quoted(x)}, {quoted(x[0] + '\\e' + x[1:])})"
        return c

    marks = len(template.before_role + template.after_role + template.close)
    moves = " OR ".join(f"(coalesce(lag(role) OVER w, 'start') = '{a}' AND role = '{b}')" for a, to in template.turns.items() for b in to)
    learned = ", ".join(f"'{x}'" for x in template.learned)
    return f"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
told AS (SELECT *, ({moves}) AS fits FROM given WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role IN ({learned})), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role IN ({learned})), '')) AS loss_sha256,
  sum({marks} + length({escaped('role')}) + length({escaped('text')}))::BIGINT AS formatted_chars,
  bool_and(fits) AS valid
FROM told GROUP BY conv_id
"""
