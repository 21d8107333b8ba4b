"""Chat formatting by schema fingerprints (operator 6), DataFrame functions only.

A record's nested field paths (not its values or scalar types) are written in one canonical
form and hashed; the hash selects a declarative mapping that turns this layout - message
lists, prompt and completion, instruction with input and output - into canonical turns. The
turns are then rendered in one template::

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

Inside a text ``&`` becomes ``&amp;`` and ``<|`` becomes ``&lt;|``, so no control string can
appear in it; in a role ``%``, ``<`` and line feeds are percent-encoded. ``read_back`` undoes
both exactly. The loss mask is kept as one run a turn: skip so many code points of the turn
after its ``<|im_start|>``, then take so many.

Defined results: a null text or role is an empty one; a record of no known layout has null
turns and formatted text and its fingerprint is kept for a mapping to be written; a record
without turns gives an empty text; a very long text is formatted whole; repeated rows are formatted
each; an empty table gives an empty result; other columns pass through, and the new ones give way
where names clash: ``chat_names`` tells what they are called then.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import column, free_name

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"
#: The columns that formatting and reading back add.
NAMES = {x: x for x in ("fingerprint", "layout", "turns", "formatted", "loss_runs", "read_turns", "loss_text")}


def chat_names(records: DataFrame) -> dict[str, str]:
    """What the added columns are called beside those of ``records``."""
    return {x: free_name(records, x) for x in NAMES}


@dataclass(frozen=True)
class MessageList:
    """A layout whose turns stand in a list: names of the list, role and text, and roles to rename."""

    name: str
    items: str
    role: str
    text: str
    roles: dict[str, str] = field(default_factory=dict)

    def schemas(self) -> list[str]:
        fields = ", ".join(f"{x}: _" for x in sorted((self.role, self.text)))
        return [f"OBJECT<{self.items}: ARRAY<OBJECT<{fields}>>>", f"OBJECT<{self.items}: ARRAY<_>>"]

    def turns(self, record: Column) -> Column:
        got = F.try_variant_get(record, f"$.{self.items}", f"array<struct<{self.role}:string,{self.text}:string>>")

        def turn(x: Column) -> Column:
            role = F.coalesce(x[self.role], F.lit(""))
            named = role
            for old, new in self.roles.items():
                named = F.when(role == old, F.lit(new)).otherwise(named)
            return F.struct(named.alias("role"), F.coalesce(x[self.text], F.lit("")).alias("text"))

        return F.transform(F.coalesce(got, F.array().cast(f"array<struct<{self.role}:string,{self.text}:string>>")), turn)


@dataclass(frozen=True)
class Fields:
    """A layout with one field a turn part: (role, fields that are joined by blank lines), in order.

    Turns whose fields are all absent, null or empty are left out if their role is optional.
    """

    name: str
    parts: tuple[tuple[str, tuple[str, ...]], ...]
    optional_roles: tuple[str, ...] = ("system",)
    optional_fields: tuple[str, ...] = ()

    def schemas(self) -> list[str]:
        names = [x for _, xs in self.parts for x in xs]
        out = [frozenset(names)]
        for x in self.optional_fields:
            out += [s - {x} for s in out]
        return [f"OBJECT<{', '.join(f'{x}: _' for x in sorted(s))}>" for s in out]

    def turns(self, record: Column) -> Column:
        made = []
        for role, names in self.parts:
            got = [F.coalesce(F.try_variant_get(record, f"$.{x}", "string"), F.lit("")) for x in names]
            text = got[0] if len(got) == 1 else F.array_join(F.filter(F.array(*got), lambda x: x != ""), "\n\n")
            made.append(F.struct(F.lit(role).alias("role"), text.alias("text")))
        if not self.optional_roles:
            return F.array(*made)
        return F.filter(F.array(*made), lambda x: (x["text"] != "") | ~x["role"].isin(*self.optional_roles))


Layout = MessageList | Fields

LAYOUTS: tuple[Layout, ...] = (
    MessageList("messages", "messages", "role", "content"),
    MessageList("dialog", "conversations", "from", "value", {"human": "user", "gpt": "assistant", "bot": "assistant"}),
    Fields("completion", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), optional_fields=("system",)),
    Fields("response", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional_fields=("system",)),
    Fields("instruction", (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional_fields=("system", "input")),
    Fields("question", (("user", ("question",)), ("assistant", ("answer",))), optional_roles=()),
)


def field_paths(record: Column) -> Column:
    """The canonical form of a variant's nested field paths: scalars of every type are ``_``."""
    return F.regexp_replace(F.schema_of_variant(record), r"(^|: |ARRAY<)(?!OBJECT<|ARRAY<)[A-Z_]+(\(\d+, ?\d+\))?(?=[,>]|$)", "$1_")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(field_paths(record))


def canonical_turns(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``records`` with fingerprint, layout (its name) and turns. ``record``: a variant column."""
    names, own = chat_names(records), column(records, record)
    marked = records.withColumn(names["fingerprint"], fingerprint(own))
    found, own = F.col(names["fingerprint"]), column(marked, record)
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for layout in reversed(layouts):
        known = found.isin(*(F.xxhash64(F.lit(s)) for s in layout.schemas()))
        name = F.when(known, F.lit(layout.name)).otherwise(name)
        turns = F.when(known, layout.turns(own).cast(TURNS)).otherwise(turns)
    return marked.withColumns({names["layout"]: name, names["turns"]: turns})


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


ROLE_CODES = (("%", "%25"), ("<", "%3C"), ("\n", "%0A"))


def escaped_role(role: Column) -> Column:
    for a, b in ROLE_CODES:
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def unescaped_role(role: Column) -> Column:
    for a, b in reversed(ROLE_CODES):
        role = F.replace(role, F.lit(b), F.lit(a))
    return role


def _joined(parts: Column, part: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(parts, part), "")


def render(records: DataFrame, learn_from: tuple[str, ...] = ("assistant",), names: dict[str, str] = NAMES) -> DataFrame:
    """``records`` (with turns) with formatted and loss_runs (skip, take: code points; one a turn)."""
    turns = F.col(names["turns"])

    def one(t: Column) -> Column:
        return F.concat(F.lit(START), escaped_role(t["role"]), F.lit("\n"), escaped(t["text"]), F.lit(END + "\n"))

    def run(t: Column) -> Column:
        learnt = t["role"].isin(*learn_from)
        return F.struct(
            (F.char_length(escaped_role(t["role"])) + 1).alias("skip"),
            F.when(learnt, F.char_length(escaped(t["text"]))).otherwise(0).alias("take"),
        )

    return records.withColumns({names["formatted"]: _joined(turns, one), names["loss_runs"]: F.transform(turns, run)})


def read_back(formatted: DataFrame, names: dict[str, str] = NAMES) -> DataFrame:
    """Turns and the text under the loss mask, from nothing but formatted and loss_runs."""
    parts = F.split(F.col(names["formatted"]), r"<\|im_start\|>", -1)
    parts = F.filter(F.transform(parts, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: p["i"] > 0)
    parts = F.transform(parts, lambda p: p["x"])

    def turn(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        size = F.char_length(head)
        body = F.substring(p, size + 2, F.char_length(p) - size - 1 - F.lit(len(END) + 1))
        return F.struct(unescaped_role(head).alias("role"), unescaped(body).alias("text"))

    def learnt(p: Column, r: Column) -> Column:
        return unescaped(F.substring(p, r["skip"] + 1, r["take"]))

    held = free_name(formatted, "parts")
    read = formatted.withColumn(held, parts)
    loss = F.array_join(F.zip_with(held, names["loss_runs"], learnt), "")
    return read.withColumns({names["read_turns"]: F.transform(held, turn), names["loss_text"]: loss}).drop(held)


def digest(read: DataFrame, key: str, names: dict[str, str] = NAMES) -> DataFrame:
    """Counts and SHA-256 digests of what ``read_back`` gives."""
    turns = _joined(F.col(names["read_turns"]), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        column(read, key).alias(key),
        F.size(names["read_turns"]).cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length(names["loss_text"]).cast("long").alias("loss_chars"),
        F.sha2(names["loss_text"], 256).alias("loss_sha256"),
        F.char_length(names["formatted"]).cast("long").alias("formatted_chars"),
    )


def conversation_records(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Rows of one turn each (key, turn, role, text) as one record a conversation, message layout.

    Turns are ordered by turn, then role and text; repeated rows stay.
    """
    rows = F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))))
    items = F.transform("rows", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    grouped = turns.groupBy(key).agg(rows.alias("rows"))
    return grouped.select(key, F.to_variant_object(F.struct(items.alias("messages"))).alias("record"))


def format_chats(records: DataFrame, record: str = "record") -> DataFrame:
    """Records of mixed layouts (variant) to fingerprint, layout, turns, formatted and loss_runs."""
    return render(canonical_turns(records, record), names=chat_names(records))
