"""Chat formatting: a finite-state machine over roles, driven by a declarative template.

Everything is Spark SQL functions.  Rows are gathered per conversation (its formatted
text is one string), sorted by turn, and run through the machine: a transition table
from state and role to the next state and to the loss flag that the turn's text is
emitted with.  The formatted text is the emitted segments joined.

So that long conversations take linear time, turns go through the machine in blocks
of ``BLOCK``: each block's map from every entry state to its exit state is made, the
maps are composed in order, and each block then emits its flags from the entry state
that it is known to have.

Reading back needs the formatted text alone: its turns go through the same machine,
whose flags pick the texts under the loss mask.

The control strings of the template start with ``<|``.  Inside texts and roles every
``<``, any number of backslashes, ``|`` gets one backslash more, so that no text can
hold a control string; taking one backslash away again restores the text exactly.

Edge cases: null texts and roles are empty; turns that tie are ordered by role, then
text; null turns come first; a null conv_id is a conversation of its own; repeated
rows are repeated turns; an order of roles that the machine does not accept is
formatted all the same and flagged ``valid = false``; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


BLOCK = 256
ERROR = "error"


@dataclass(frozen=True)
class ChatTemplate:
    """What marks a turn, which orders of roles are valid, and which turns are trained on."""

    begin: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>\n"
    start: str = "start"
    #: state -> role -> next state; a pair that is missing leads to "error" for good.
    moves: dict = field(default_factory=lambda: {"start": {"system": "told", "user": "asked"}, "told": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}})
    accept: tuple[str, ...] = ("answered", "asked")
    #: state -> roles whose text is emitted with the loss flag; "" stands for every state.
    trained: dict = field(default_factory=lambda: {"": ("assistant",)})

    @property
    def states(self) -> list[str]:
        return list(dict.fromkeys([self.start, *self.moves, *(to for by_role in self.moves.values() for to in by_role.values()), ERROR]))

    def table(self) -> dict[str, str]:
        """The machine: "state>role" to the flag (0 or 1) and the next state, for every pair that is not "no flag, and to the error"."""
        roles = {r for by_role in self.moves.values() for r in by_role} | {r for some in self.trained.values() for r in some}
        rows = {}
        for state in self.states:
            for role in sorted(roles):
                flag = role in self.trained.get("", ()) or role in self.trained.get(state, ())
                rows[f"{state}>{role}"] = f"{int(flag)}{self.moves.get(state, {}).get(role, ERROR)}"
        return rows


#: A line break in a role would end it; this stands for it and cannot come from a text.
_BREAK = "<|nl|>"


def escape(x: Column) -> Column:
    return F.regexp_replace(x, r"<(\\*)\|", r"<$1\\|")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"<(\\*)\\\|", r"<$1|")


def _role_out(x: Column) -> Column:
    return F.replace(escape(x), F.lit("\n"), F.lit(_BREAK))


def _role_in(x: Column) -> Column:
    return unescape(F.replace(x, F.lit(_BREAK), F.lit("\n")))


def _runs(turns: Column, template: ChatTemplate) -> Column:
    """(turns, entry): the turns in blocks, each with the state in which the machine enters it."""
    step, start = _step(template), F.lit(template.start)
    n = F.greatest(F.ceil(F.size(turns) / BLOCK), F.lit(1)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(turns, k * BLOCK + 1, BLOCK))
    maps = F.transform(F.slice(blocks, 1, F.size(blocks) - 1), lambda b: F.map_from_arrays(F.array(*map(F.lit, template.states)), F.transform(F.array(*map(F.lit, template.states)), lambda s: F.aggregate(b, s, lambda at, x: F.substring(step(at, x["role"]), 2, 99)))))
    entries = F.aggregate(maps, F.array(start), lambda found, m: F.concat(found, F.array(F.element_at(m, F.element_at(found, -1)))))
    return F.zip_with(blocks, entries, lambda b, s: F.struct(b.alias("turns"), s.alias("entry")))


def _step(template: ChatTemplate):
    """The transition: flag and next state, as one string."""
    table = F.create_map(*[F.lit(x) for row in template.table().items() for x in row])
    return lambda state, role: F.coalesce(F.try_element_at(table, F.concat(state, F.lit(">"), role)), F.lit("0" + ERROR))


def _flagged(runs: Column, template: ChatTemplate, emit) -> Column:
    """``emit`` (turn, loss flag) of every turn, in order; the flags are those of the machine's transitions."""
    step = _step(template)

    def walk(at: Column, x: Column) -> Column:
        to = step(at["state"], x["role"])
        return F.struct(F.substring(to, 2, 99).alias("state"), F.concat(at["flags"], F.substring(to, 1, 1)).alias("flags"))

    def block(run: Column) -> Column:
        flags = F.aggregate(run["turns"], F.struct(run["entry"].alias("state"), F.lit("").alias("flags")), walk, lambda at: at["flags"])
        # transform over a single flags string computes it once per block
        return F.flatten(F.transform(F.array(flags), lambda f: F.transform(run["turns"], lambda x, k: emit(x, F.substring(f, k + 1, F.lit(1)) == "1"))))

    return F.flatten(F.transform(runs, block))


def _final(runs: Column, template: ChatTemplate) -> Column:
    step, last = _step(template), F.element_at(runs, -1)
    return F.aggregate(last["turns"], last["entry"], lambda at, x: F.substring(step(at, x["role"]), 2, 99))


def format_chats(rows: DataFrame, template: ChatTemplate | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, valid, final_state, segments (text, loss) and formatted per conversation."""
    t = template or ChatTemplate()
    role = F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit(""))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    turns = rows.select(F.col(f"`{conv_col}`").alias("conv_id"), F.struct(F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), text.alias("text")).alias("row"))
    turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))
    turns = turns.select("conv_id", _runs(F.col("turns"), t).alias("runs"))

    def segment(x: Column, loss: Column) -> Column:
        return F.struct(x.alias("text"), loss.alias("loss"))

    no = F.lit(False)
    segments = F.flatten(_flagged(F.col("runs"), t, lambda x, loss: F.array(segment(F.concat(F.lit(t.begin), _role_out(x["role"]), F.lit(t.after_role)), no), segment(escape(x["text"]), loss), segment(F.lit(t.end), no))))
    out = turns.select("conv_id", _final(F.col("runs"), t).alias("final_state"), segments.alias("segments"))
    return out.select("conv_id", F.col("final_state").isin(*t.accept).alias("valid"), "final_state", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def parse_chats(formatted: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Add ``turns`` (role, text, loss), read from the formatted text alone: the machine flags the turns that it reads."""
    t = template or ChatTemplate()
    pieces = F.split("formatted", re.escape(t.end).replace("\\\n", "\\n"), -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(x: Column) -> Column:
        body = F.substring(x, len(t.begin) + 1, 2147483647)
        role = F.substring_index(body, t.after_role, 1)
        return F.struct(_role_in(role).alias("role"), unescape(F.substring(body, F.length(role) + F.lit(len(t.after_role) + 1), F.lit(2147483647))).alias("text"))

    read = formatted.withColumn("turns", F.transform(pieces, turn))
    return read.withColumn("turns", _flagged(_runs(F.col("turns"), t), t, lambda x, loss: F.struct(x["role"].alias("role"), x["text"].alias("text"), loss.alias("loss"))))


def chat_digests(rows: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Digests of what is read back from the formatted output, and the machine's verdict."""
    chats = format_chats(rows, template).select("conv_id", "valid", "final_state", "formatted")
    back = parse_chats(chats, template)
    nl = F.lit("\n")
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], nl, x["text"], nl)), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda x: x["loss"]), lambda x: x["text"]), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid", "final_state")
