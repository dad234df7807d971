r"""Chat formatting by schema fingerprints.

A record is a JSON text, or a variant, of any layout.  The nested paths of its fields, as a
canonical skeleton (``OBJECT<messages: ARRAY<OBJECT<content, role>>>``), are
hashed to a fingerprint; the fingerprint selects a declarative ``Layout`` that
says where the turns lie.  A record whose fingerprint no layout declares (it
has further fields, say) takes the first layout whose required paths it holds.

The template is ``<|im_start|>role\ntext<|im_end|>\n`` a turn.  Inside texts and
roles each ``<\..\|`` gets one more backslash between ``<`` and ``|``, so no control string
survives there, and taking one backslash away restores the text exactly.  In
roles, backslashes and line ends are escaped first, as a role ends at the line.

Only DataFrame functions run here.
"""

from __future__ import annotations

import hashlib
import itertools
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


class Layout(NamedTuple):
    """``turns``: the path of a list of turns with the names of its role and
    text fields; or ``fields``: (role, paths) in order, the texts of a role
    joined by an empty line.  ``optional`` paths may be absent."""

    name: str
    turns: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    @property
    def required(self) -> tuple[str, ...]:
        if self.turns:
            path, role, text = self.turns
            return (f"{path}[].{role}", f"{path}[].{text}")
        return tuple(p for _, ps in self.fields for p in ps if p not in self.optional)


SHARE_ROLES = (("human", "user"), ("gpt", "assistant"))
LAYOUTS = (
    Layout("messages", turns=("messages", "role", "content"), optional=("messages[].turn", "messages[].name")),
    Layout("turn_texts", turns=("messages", "role", "text"), optional=("messages[].turn",)),
    Layout("from_value", turns=("conversations", "from", "value"), optional=("system",), roles=SHARE_ROLES),
    Layout("instruction", fields=(("system", ("system",)), ("user", ("instruction", "input")),
                                  ("assistant", ("output",))), optional=("input", "system")),
    Layout("prompt_completion", fields=(("system", ("system",)), ("user", ("prompt",)),
                                        ("assistant", ("completion",))), optional=("system",)),
    Layout("prompt_response", fields=(("system", ("system",)), ("user", ("prompt",)),
                                      ("assistant", ("response",))), optional=("system",)),
    Layout("question_answer", fields=(("user", ("context", "question")), ("assistant", ("answer",))),
           optional=("context",)),
)


def skeleton(paths) -> str:
    """The canonical text of a set of nested field paths (``a[].b`` style)."""
    tree: dict = {}
    for path in paths:
        at = tree
        for part in path.split("."):
            at = at.setdefault(part, {})

    def text(node: dict) -> str:
        parts = []
        for name in sorted(node, key=lambda x: x.removesuffix("[]")):
            inner = text(node[name]) if node[name] else ""
            if name.endswith("[]"):
                inner = f": ARRAY<{inner}>" if inner else ": ARRAY<>"
            elif inner:
                inner = f": {inner}"
            parts.append(name.removesuffix("[]") + inner)
        return f"OBJECT<{', '.join(parts)}>"

    return text(tree)


def declared(layout: Layout) -> list[str]:
    """The fingerprints of a layout: its required paths with any of the optional ones."""
    some = [c for n in range(len(layout.optional) + 1) for c in itertools.combinations(layout.optional, n)]
    return [hashlib.sha256(skeleton([*layout.required, *c]).encode()).hexdigest() for c in some]


def fingerprint(value: Column) -> Column:
    """Hash of the nested field paths of a variant; field types don't count."""
    return F.sha2(F.regexp_replace(F.schema_of_variant(value), r": [A-Z_]+(\(\d+,\d+\))?(?=[,>])", ""), 256)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    # a doubled backslash is put aside (as NUL and a mark) while \n is restored
    plain = F.replace(F.replace(unescape(role), F.lit("\0"), F.lit("\0z")), F.lit("\\\\"), F.lit("\0b"))
    plain = F.replace(plain, F.lit("\\n"), F.lit("\n"))
    return F.replace(F.replace(plain, F.lit("\0b"), F.lit("\\")), F.lit("\0z"), F.lit("\0"))


def _turns(value: Column, layout: Layout) -> Column:
    """array<struct<role, text>> of a record by a layout."""
    get = lambda path, kind="string": F.try_variant_get(value, f"$.{path}", kind)
    empty = F.lit("")

    def turn(role: Column, text: Column) -> Column:
        return F.struct(role.alias("role"), text.alias("text"))

    if layout.turns:
        path, role, text = layout.turns
        rows = get(path, f"array<struct<`{role}`: string, `{text}`: string>>")
        named = F.create_map(*[F.lit(x) for pair in layout.roles for x in pair]) if layout.roles else None

        def one(x: Column) -> Column:
            who = F.coalesce(x[role], empty)
            return turn(F.coalesce(named[who], who) if named is not None else who, F.coalesce(x[text], empty))

        out = F.transform(rows, one)
        if "system" in layout.optional:
            head = get("system")
            out = F.when(head.isNull(), out).otherwise(F.concat(F.array(turn(F.lit("system"), head)), out))
        return out
    parts = []
    for role, paths in layout.fields:
        text = F.concat_ws("\n\n", *[F.nullif(get(p), F.lit("")) if p in layout.optional else get(p) for p in paths])
        there = F.lit(True) if any(p not in layout.optional for p in paths) else text != ""
        parts.append(F.when(there, turn(F.lit(role), text)))
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def canonical(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``records`` with fingerprint, layout and turns (array of role and text).

    Null texts and roles are empty.  A record that is null or no JSON object
    has layout 'unreadable', one that no layout fits 'unknown'; both have no
    turns.  Other columns pass through, but those named as the new ones are
    replaced."""
    value = F.col(record) if dict(records.dtypes)[record] == "variant" else F.try_parse_json(F.col(record))
    at = F.col("__value")
    out = records.withColumn("__value", value).withColumn("fingerprint", fingerprint(at))
    name = F.when(at.isNull() | ~F.schema_of_variant(at).startswith("OBJECT"), F.lit("unreadable"))
    for x in layouts:
        name = name.when(F.col("fingerprint").isin(declared(x)), F.lit(x.name))
    for x in layouts:
        holds = [F.try_variant_get(at, f"$.{p.split('[]')[0]}", "variant").isNotNull() for p in x.required]
        if x.turns:  # and each of the two fields occurs in some turn
            s = F.schema_of_variant(F.try_variant_get(at, f"$.{x.turns[0]}", "variant"))
            holds += [s.rlike(rf"^ARRAY<OBJECT<([^<>]*, )?{f}: ") for f in x.turns[1:]]
        fits = holds[0]
        for h in holds[1:]:
            fits = fits & h
        name = name.when(fits, F.lit(x.name))
    out = out.withColumn("layout", name.otherwise(F.lit("unknown")))
    turns = F.when(F.lit(False), F.array(F.struct(F.lit("").alias("role"), F.lit("").alias("text"))))
    for x in layouts:
        turns = turns.when(F.col("layout") == x.name, _turns(at, x))
    none = F.from_json(F.lit("[]"), "array<struct<role: string, text: string>>")
    return out.withColumn("turns", F.coalesce(turns, none)).drop("__value")


def render(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """Adds ``chunks`` (array of text and loss, in order) and ``formatted``, the
    concatenation of the chunks.  The texts of role ``trained`` are the loss
    mask.  Records without turns give an empty text."""
    def chunk(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def of(x: Column) -> Column:
        return F.array(chunk(F.concat(F.lit(START), _escape_role(x["role"]), F.lit("\n")), F.lit(False)),
                       chunk(escape(x["text"]), x["role"] == trained),
                       chunk(F.lit(END + "\n"), F.lit(False)))

    out = turns.withColumn("chunks", F.flatten(F.transform("turns", of)))
    return out.withColumn("formatted", F.array_join(F.col("chunks.text"), ""))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> from a formatted text."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x: x != "")

    def of(x: Column) -> Column:
        body = F.substring_index(x, END, 1)
        role = F.substring_index(body, "\n", 1)
        text = F.substr(body, F.char_length(role) + F.lit(2))
        return F.struct(_unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, of)


def masked_text(chunks: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(chunks, lambda x: x["loss"]), lambda x: unescape(x["text"])), "")


def records_of_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, record): the rows conv_id, turn, role, text of a conversation
    as one variant record, by turn; turns of one number are ordered by role and
    text, repeated rows stay, null turns come first.  A conversation is one
    value of the result; Spark's bound of a variant, 128 MiB, is its bound too."""
    turn = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    out = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("messages"))
    return out.select("conv_id", F.to_variant_object(F.struct("messages")).alias("record"))
