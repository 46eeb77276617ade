"""Chat formatting: heterogeneous records become canonical turns, then one templated text with a loss mask.

The nested field paths of each JSON record are hashed to a fingerprint, and the fingerprint picks a declarative
mapping (a ``Layout``) that says where roles and texts are. Everything is DataFrame expressions.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that must not stand unescaped inside a text: this template's and those of other common templates.
_BODY = r"(\|(?:turn|text|end)\|>|/?s>|/?INST\])"
#: Spark parses no variant over 128 MiB nor any with a string over 20 000 000 characters: records of more bytes than ``LONG`` don't
#: go through a variant whole.
LONG, LARGEST_VARIANT = 8 << 20, 128 << 20
_JSON = {"maxStringLen": str((1 << 31) - 1)}
_FIND, _FIND_ESCAPED = r"([<\[])(\\*)" + _BODY, r"([<\[])\\(\\*)" + _BODY


@dataclass(frozen=True)
class Layout:
    """Where the turns of a record are. ``each``: an array with a role and a text field in every element;
    else ``fields``: (role, field, optional) in the order of the turns."""

    name: str
    each: str = ""
    role: str = ""
    text: str = ""
    renames: tuple[tuple[str, str], ...] = ()
    fields: tuple[tuple[str, str, bool], ...] = ()

    def variants(self) -> list[tuple[str, tuple[tuple[str, str, bool], ...]]]:
        """(field paths, fields present) of every form of the layout."""
        if self.each:
            inner = ", ".join(sorted((self.role, self.text)))
            return [(f"OBJECT<{self.each}: ARRAY<OBJECT<{inner}>>>", ()), (f"OBJECT<{self.each}: ARRAY>>", ())]
        optional = [f for f in self.fields if f[2]]
        return [
            ("OBJECT<" + ", ".join(sorted(f[1] for f in self.fields if f not in gone)) + ">", tuple(f for f in self.fields if f not in gone))
            for n in range(len(optional) + 1)
            for gone in combinations(optional, n)
        ]

    def turns(self, record: Column, present: tuple[tuple[str, str, bool], ...]) -> Column:
        """From a record as a variant."""
        if not self.each:
            return F.array(*[_turn(F.lit(role), F.try_variant_get(record, f"$.{field}", "string")) for role, field, _ in present])
        return self._items(F.try_variant_get(record, f"$.{self.each}", f"array<struct<{self.role}:string,{self.text}:string>>"))

    def long_turns(self, record: Column, present: tuple[tuple[str, str, bool], ...]) -> Column:
        """From a record as text; null if it isn't JSON."""
        fields = f"{self.each} array<struct<{self.role}:string,{self.text}:string>>" if self.each else ", ".join(f"{field} string" for _, field, _ in present)
        parsed = F.from_json(record, f"{fields}, _corrupt_record string", _JSON)
        turns = self._items(parsed[self.each]) if self.each else F.array(*[_turn(F.lit(role), parsed[field]) for role, field, _ in present])
        return F.when(parsed["_corrupt_record"].isNull(), turns)

    def _items(self, items: Column) -> Column:
        def one(item: Column) -> Column:
            role = item[self.role]
            for old, new in self.renames:
                role = F.when(item[self.role] == old, F.lit(new)).otherwise(role)
            return _turn(role, item[self.text])

        return F.transform(items, one)


LAYOUTS = (
    Layout("messages", each="messages", role="role", text="content"),
    Layout("conversations", each="conversations", role="from", text="value", renames=(("human", "user"), ("gpt", "assistant"))),
    Layout("prompt", fields=(("system", "system", True), ("user", "prompt", False), ("assistant", "response", False))),
    Layout("completion", fields=(("user", "prompt", False), ("assistant", "completion", False))),
    Layout("instruction", fields=(("system", "context", True), ("user", "instruction", False), ("user", "input", True), ("assistant", "output", False))),
)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def field_paths(record: Column) -> Column:
    """The record's nested field paths, without the types of their values."""
    return F.regexp_replace(F.schema_of_variant(record), r"(: |<)(?:STRING|VOID|BOOLEAN|BIGINT|DOUBLE|DECIMAL\(\d+, ?\d+\)|VARIANT)(?=[,>])|<>", "")


def skeleton(record: Column) -> Column:
    """The record with empty strings as values: it has the same field paths. Keys with escapes are altered."""
    plain = F.regexp_replace(record, r"(?s)\\.", "?")
    return F.regexp_replace(plain, r'("[^"]*+"\s*+:)|(")[^"]*+(")', "$1$2$3")


def _variant(record: Column) -> Column:
    """The record, or the skeleton of a long one, as a variant; null if it isn't JSON. An error if even the skeleton is too large."""
    short = skeleton(record)
    large = F.raise_error(F.concat(F.lit("A chat record's field paths don't fit a variant; its bytes: "), F.octet_length(record).cast("string"))).cast("variant")
    long = F.when(F.octet_length(short) > LARGEST_VARIANT, F.coalesce(F.try_parse_json(short), large)).otherwise(F.try_parse_json(short))
    return F.when(F.octet_length(record) > LONG, long).otherwise(F.try_parse_json(record))


def fingerprint(paths: str) -> str:
    return hashlib.sha256(paths.encode()).hexdigest()[:16]


def escape(text: Column) -> Column:
    """Put one more backslash after the first character of every control string; ``unescape`` takes it back."""
    return F.regexp_replace(text, _FIND, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _FIND_ESCAPED, "$1$2$3")


def canonical_turns(records: DataFrame, record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Add ``fingerprint``, ``layout`` and ``turns`` (array of role and text).

    Records that aren't JSON or whose fingerprint no layout has keep their row, with null layout and null turns.
    Columns of these names in the input are replaced. Records of over ``LONG`` bytes give their field paths by a skeleton and their
    turns by ``from_json``: their texts have no limit but that of a row.
    """
    long = F.octet_length("__record") > LONG
    out = records.withColumn("__record", F.col(record_col)).withColumn("__variant", _variant(F.col("__record"))).withColumn("fingerprint", F.substring(F.sha2(field_paths(F.col("__variant")), 256), 1, 16))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for layout in layouts:
        for paths, present in layout.variants():
            hit = F.col("fingerprint") == fingerprint(paths)
            name = F.when(hit, F.lit(layout.name)).otherwise(name)
            turns = F.when(hit & long, layout.long_turns(F.col("__record"), present)).when(hit, layout.turns(F.col("__variant"), present)).otherwise(turns)
    out = out.withColumn("turns", turns)
    return out.withColumn("layout", F.when(~long | F.col("turns").isNotNull(), name)).drop("__variant", "__record")


def format_chat(records: DataFrame, record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS, trained_role: str = "assistant") -> DataFrame:
    """``canonical_turns`` plus ``pieces`` (array of piece and loss) and ``formatted``, the pieces joined.

    ``loss`` is true on the texts of ``trained_role``. No turns: no pieces and an empty text; unmapped
    records: null. Nulls inside turns count as empty, and texts of any length pass whole.
    """
    piece = lambda text, loss: F.struct(text.alias("piece"), loss.alias("loss"))
    no = F.lit(False)
    out = canonical_turns(records, record_col, layouts).withColumn(
        "pieces",
        F.flatten(
            F.transform(
                "turns",
                lambda t: F.array(
                    piece(F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT)), no),
                    piece(escape(t["text"]), t["role"] == trained_role),
                    piece(F.lit(END), no),
                ),
            )
        ),
    )
    return out.withColumn("formatted", F.array_join(F.transform("pieces", lambda p: p["piece"]), ""))


def read_turns(formatted: Column) -> Column:
    """The turns that a formatted text holds."""
    parts = F.filter(F.split(formatted, r"<\|turn\|>"), lambda p: p.contains(TEXT))
    return F.transform(
        F.transform(parts, lambda p: F.split(p, r"<\|text\|>|<\|end\|>")),
        lambda s: F.struct(unescape(s[0]).alias("role"), unescape(s[1]).alias("text")),
    )


def read_loss(pieces: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(F.filter(pieces, lambda p: p["loss"]), lambda p: unescape(p["piece"])), "")


def as_records(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as one JSON record per conversation, in the layout that its roles allow.

    Rows go by turn, then role and text; null turns first, null roles and texts as empty. A question with
    its answer becomes a prompt record, one after a system text an instruction record; conversations
    that open with a system text are message lists, others from/value lists.
    """
    rows = conversations.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    roles = F.transform("t", lambda x: x["role"])
    is_roles = lambda *names: roles == F.array(*map(F.lit, names))
    text = lambda i: F.get("t", F.lit(i))["text"]
    lists = lambda a, b: F.transform("t", lambda x: F.struct(x["role"].alias(a), x["text"].alias(b)))
    return grouped.select(
        "conv_id",
        F.when(is_roles("user", "assistant"), F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response"))))
        .when(is_roles("system", "user", "assistant"), F.to_json(F.struct(text(0).alias("context"), text(1).alias("instruction"), text(2).alias("output"))))
        .when(F.get(roles, F.lit(0)) == "system", F.to_json(F.struct(lists("role", "content").alias("messages"))))
        .otherwise(F.to_json(F.struct(lists("from", "value").alias("conversations"))))
        .alias("record"),
    )
