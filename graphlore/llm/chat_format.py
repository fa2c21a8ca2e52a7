"""Chat formatting by schema fingerprinting.

A layout's fingerprint is the digest of its nested field paths, sorted. The
registry holds one for each declarative mapping. Of a table, or of one JSON
value, the paths that a mapping knows are hashed for each mapping, and these
digests alone, looked up in the registry, say which layouts are there in
full, also beside each other; the first of them in the order of the mappings
is used. Its mapping turns the value into canonical turns
``array<struct<role, text>>``.
Canonical turns are rendered with a template whose markers cannot occur
inside a text, because ``& < >`` are escaped reversibly, and a loss mask of
code-point spans covers what the assistant says.

Defined results: a null role or text counts as empty, also where a JSON value
says null; an empty or null array of messages has no turns; an empty table
gives an empty result; a null key is a conversation of its own; repeated rows
stay separate turns; ties in the turn number are ordered by role, then text;
columns and fields that no mapping names are ignored, whatever they are
called; a key column of any name comes back under it, but for one that is
called like a result, which comes back with ``_key`` behind its name; results
replace columns of their names. A layout that no mapping fits raises ``ValueError`` (for a table) or
gives null turns and the layout ``unknown`` (for a JSON value, also for a text
that is no JSON).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"
#: Names under which other layouts know the canonical roles; fixed values.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """A layout: its nested paths, and how they become turns.

    ``rows``: (order, role, text) columns of one row for each turn.
    ``items``: (array, role, text) fields of one array of messages.
    ``fields``: (role, paths) pairs, each one turn made of the named fields.
    """

    name: str
    rows: tuple[str, str, str] | None = None
    items: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def paths(self) -> list[str]:
        if self.rows:
            return sorted(f"{x}:{'int' if x == self.rows[0] else 'string'}" for x in self.rows)
        if self.items:
            return sorted(f"{self.items[0]}[].{x}:string" for x in self.items[1:])
        return sorted(f"{p}:string" for _, ps in self.fields for p in ps)


#: Where several layouts are there in full, the first in this order is used.
MAPPINGS = (
    Mapping("turn_rows", rows=("turn", "role", "text")),
    Mapping("messages", items=("messages", "role", "content")),
    Mapping("shared_conversations", items=("conversations", "from", "value")),
    Mapping("nested_chat", items=("chat.turns", "speaker", "utterance")),
    Mapping("instruction_input", fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("instruction", fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("system_prompt", fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt_completion", fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt_response", fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question_answer", fields=(("user", ("question",)), ("assistant", ("answer",)))),
)


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested paths of a type with the kind of each leaf, sorted."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    leaf = "string" if isinstance(kind, T.StringType) else "int" if isinstance(kind, T.IntegralType) else kind.typeName()
    return [f"{at}:{leaf}"]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def registry(mappings: tuple[Mapping, ...] = MAPPINGS) -> dict[str, int]:
    """The place in the order of mappings for the fingerprint of each layout."""
    found: dict[str, int] = {}
    for k, m in enumerate(mappings):
        found.setdefault(fingerprint(m.paths()), k)
    return found


def select_mapping(schema: T.StructType, mappings: tuple[Mapping, ...] = MAPPINGS) -> Mapping:
    """The mapping registered for a fingerprint of a table's paths."""
    there, known = set(field_paths(schema)), registry(mappings)
    found = [known[f] for m in mappings if (f := fingerprint(sorted(there.intersection(m.paths())))) in known]
    if not found:
        raise ValueError(f"no mapping fits the layout {sorted(there)}")
    return mappings[min(found)]


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _key_name(key: str) -> str:
    return f"{key}_key" if key.lower() in ("turns", "layout") else key


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def _role(value: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in ROLE_NAMES.items() for x in kv])
    return F.coalesce(known[F.lower(_text(value))], _text(value))


def _item_turns(items: Column, role: str, text: str) -> Column:
    return F.transform(items, lambda x: F.struct(_role(x[role]).alias("role"), _text(x[text]).alias("text")))


def _field_turns(m: Mapping, get) -> Column:
    turns = []
    for role, paths in m.fields:
        parts = [_text(get(p)) for p in paths]
        full = F.concat_ws("\n\n", *[F.when(x != "", x) for x in parts]) if len(parts) > 1 else parts[0]
        turns.append(F.struct(F.lit(role).alias("role"), full.alias("text")))
    made = F.array(*turns)
    return F.filter(made, lambda t: (t["role"] != "system") | (t["text"] != ""))


def canonical_turns(df: DataFrame, key: str) -> DataFrame:
    """One row for each value of ``key``: the key, its turns and the mapping's name.

    Rows of the layout ``turn_rows`` are grouped by key, which is the unit of
    the result: one conversation is one output text, so its turns meet in one
    row however they are dealt. The other layouts need no shuffle.
    """
    m = select_mapping(df.drop(key).schema)
    if m.rows:
        order, role, text = m.rows
        one = F.struct(F.col(order).alias("o"), _text(F.col(role)).alias("role"), _text(F.col(text)).alias("text"))
        grouped = df.groupBy(_column(key).alias("key")).agg(F.array_sort(F.collect_list(one)).alias("all"))
        turns = F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
        return grouped.select(F.col("key").alias(_key_name(key)), turns.alias("turns"), F.lit(m.name).alias("layout"))
    if m.items:
        field, role, text = m.items
        turns = _item_turns(F.coalesce(F.col(field), F.array().cast(df.select(field).schema[0].dataType)), role, text)
    else:
        turns = _field_turns(m, lambda p: F.col(p))
    return df.select(_column(key).alias(_key_name(key)), turns.alias("turns"), F.lit(m.name).alias("layout"))


def _is_text(value: Column, field: str) -> Column:
    """Whether an object has a field that is a plain value or null."""
    kind = F.schema_of_variant(F.try_variant_get(value, f"$.{field}", "variant"))
    return F.coalesce(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY"), F.lit(False))


def _items(field: str) -> Column:
    """The elements of an array of messages; none where it is null."""
    found = F.try_variant_get("v", f"$.{field}", "array<variant>")
    null = F.schema_of_variant(F.try_variant_get("v", f"$.{field}", "variant")) == "VOID"
    return F.coalesce(found, F.when(null, F.array().cast("array<variant>")))


def _variant_turns(field: str, role: str, text: str) -> Column:
    value = lambda x, name: F.try_variant_get(x, f"$.{name}", "string")
    return F.transform(_items(field), lambda x: F.struct(_role(value(x, role)).alias("role"), _text(value(x, text)).alias("text")))


def turns_from_json(df: DataFrame, key: str, column: str) -> DataFrame:
    """As :func:`canonical_turns` for rows that each hold a JSON text of their own layout."""
    mappings = tuple(m for m in MAPPINGS if not m.rows)
    df = df.select(F.struct(_column(key).alias("own")).alias("key"), F.try_parse_json(_column(column)).alias("v"))

    def there(path: str) -> Column:
        at = path.partition(":")[0]
        if "[]" not in at:
            return _is_text(F.col("v"), at)
        items, field = _items(at.partition("[]")[0]), at.partition("[].")[2]
        return F.coalesce((F.size(items) == 0) & items.isNotNull(), F.lit(False)) | F.coalesce(F.exists(items, lambda x: _is_text(x, field)), F.lit(False))

    paths = sorted({p for m in mappings for p in m.paths()})
    df = df.withColumn("found", F.filter(F.array(*[F.when(there(p), F.lit(p)) for p in paths]), lambda p: p.isNotNull()))
    digests = F.array(*[F.sha2(F.array_join(F.array_intersect(F.array(*map(F.lit, m.paths())), "found"), "\n"), 256) for m in mappings])
    known = F.create_map(*[F.lit(x) for kv in registry(mappings).items() for x in kv])
    names = F.array(*[F.lit(m.name) for m in mappings])
    first = F.array_min(F.transform(digests, lambda d: known[d]))
    df = df.select("key", "v", F.coalesce(F.get(names, first), F.lit("unknown")).alias("layout"))
    turns = F.lit(None).cast(TURNS)
    for m in mappings:
        if m.items:
            made = _variant_turns(*m.items)
        else:
            made = _field_turns(m, lambda p: F.try_variant_get("v", f"$.{p}", "string"))
        turns = F.when(F.col("layout") == m.name, made).otherwise(turns)
    return df.select(F.col("key.own").alias(_key_name(key)), turns.alias("turns"), "layout")


def escape(text: Column) -> Column:
    """Replace the characters that markers are made of; undone by :func:`unescape`."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in ((">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def format_chat(df: DataFrame, turns: str = "turns", learn_from: str = "assistant") -> DataFrame:
    """Add ``formatted`` and ``loss_spans``: code-point spans of the text to learn from, escaped, ends exclusive."""
    head = lambda t: F.concat(F.lit("<turn "), escape(t["role"]), F.lit(">\n"))
    made = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), head(t).alias("head"), escape(t["text"]).alias("body")))
    rest = [c for c in df.columns if c not in ("formatted", "loss_spans")]
    held = "made"
    while held in rest:
        held += "_"
    df = df.select(*map(_column, rest), made.alias(held))
    formatted = F.array_join(F.transform(held, lambda t: F.concat(t["head"], t["body"], F.lit("</turn>\n"))), "")
    span = "struct<start:bigint,end:bigint>"
    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{span}>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(t["head"])
        end = start + F.length(t["body"])
        own = F.array(F.struct(start.alias("start"), end.alias("end")))
        spans = F.when(t["role"] == learn_from, F.concat(acc["spans"], own)).otherwise(acc["spans"])
        return F.struct((end + len("</turn>\n")).cast("bigint").alias("at"), spans.cast(f"array<{span}>").alias("spans"))

    spans = F.aggregate(held, empty, step, lambda acc: acc["spans"])
    return df.select(*map(_column, rest), formatted.alias("formatted"), spans.alias("loss_spans"))


def parse_chat(formatted: Column) -> Column:
    """The turns that a formatted text holds."""
    pieces = F.split(formatted, "</turn>\n")
    pieces = F.filter(pieces, lambda p: p != "")

    def turn(p: Column) -> Column:
        head = F.substring_index(p, ">\n", 1)
        return F.struct(unescape(F.substr(head, F.lit(7))).alias("role"), unescape(F.substr(p, F.length(head) + 3)).alias("text"))

    return F.transform(pieces, turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
