"""Chat formatting by schema fingerprints. DataFrame functions only.

The nested field paths of a record (or of a table) are hashed; the hash selects a declarative mapping, and the mapping turns the
record's layout, a prompt with its answer, an instruction, or a list of messages, into canonical turns (role, text).
Turns are written in one template that marks each of them, escapes control strings inside texts so that they can be
restored, and tells which characters count for the loss.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that a template or tokenizer may read as control; a backslash is put behind their first character.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LEARNED_ROLE = "assistant"
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """turns: (role, path) in order, for records of fixed fields; or items: (list path, role field, text field), for lists of messages;
    or row: (turn field, role field, text field), for records that are a turn each."""

    paths: tuple[str, ...]
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    items: tuple[str, str, str] | None = None
    row: tuple[str, str, str] | None = None


#: More specific mappings first.
MAPPINGS = (
    Mapping(("turn", "role", "text"), row=("turn", "role", "text")),
    Mapping(("messages[].content", "messages[].role"), items=("messages", "role", "content")),
    Mapping(("conversations[].from", "conversations[].value"), items=("conversations", "from", "value")),
    Mapping(("system", "instruction", "input", "output"), turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping(("system", "instruction", "output"), turns=(("system", ("system",)), ("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping(("instruction", "input", "output"), turns=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping(("instruction", "output"), turns=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping(("instruction", "response"), turns=(("user", ("instruction",)), ("assistant", ("response",)))),
    Mapping(("system", "prompt", "response"), turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping(("prompt", "response"), turns=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping(("prompt", "completion"), turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping(("question", "answer"), turns=(("user", ("question",)), ("assistant", ("answer",)))),
)
def fingerprint(paths: Column, m: Mapping) -> Column:
    """Hash of those of a record's field paths that the mapping names, in order of name; other fields don't change it."""
    return F.xxhash64(F.array_sort(F.array_intersect(paths, F.array(*map(F.lit, m.paths)))))


_LISTS = sorted({m.items[0] for m in MAPPINGS if m.items})
_TURNS = "array<struct<turn:long,role:string,text:string>>"


class _Json:
    """A column of JSON objects."""

    def __init__(self, record: Column):
        self.record = record
        top = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))
        #: Field paths, to the depth that mappings need: a.b as a[].b where a is a list of objects.
        self.paths = F.concat(top, *map(self._inside, _LISTS))

    def _inside(self, name: str) -> Column:
        items = F.from_json(self.field(name), "array<string>")
        keys = F.flatten(F.transform(items, lambda x: F.coalesce(F.json_object_keys(x), F.array().cast("array<string>"))))
        return F.coalesce(F.transform(keys, lambda k: F.concat(F.lit(f"{name}[]."), k)), F.array().cast("array<string>"))

    def has(self, m: Mapping) -> bool:
        return True

    def number(self, path: str) -> Column:
        return self.field(path).try_cast("long")

    def field(self, path: str) -> Column:
        return F.get_json_object(self.record, f"$.{path}")

    def items(self, name: str, role: str, text: str) -> Column:
        return F.from_json(self.field(name), f"array<struct<`{role}`:string,`{text}`:string>>")


class _Columns:
    """A table whose columns are the fields: its paths come from the schema, the same for every row."""

    def __init__(self, df: DataFrame, but: str):
        self.kinds = {f.name: f.dataType for f in df.schema.fields if f.name != but}
        paths = list(self.kinds)
        for name in _LISTS:
            inner = getattr(self.kinds.get(name), "elementType", None)
            paths += [f"{name}[].{c}" for c in getattr(inner, "names", ())]
        self.known = set(paths)
        self.paths = F.array(*map(F.lit, paths)).cast("array<string>")

    def has(self, m: Mapping) -> bool:
        return set(m.paths) <= self.known

    def number(self, path: str) -> Column:
        return F.col(f"`{path}`").cast("long")

    def field(self, path: str) -> Column:
        nested = self.kinds[path].typeName() in ("array", "map", "struct", "variant")
        return F.to_json(f"`{path}`") if nested else F.col(f"`{path}`").cast("string")

    def items(self, name: str, role: str, text: str) -> Column:
        return F.transform(F.col(f"`{name}`"), lambda x: F.struct(x[role].cast("string").alias(role), x[text].cast("string").alias(text)))


def _canonical(source: _Json | _Columns) -> Column:
    """array<struct<turn, role, text>> by the first mapping whose fingerprint source's paths have, that is, which is contained in them; null where none is."""
    role = lambda r: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), F.lower(r)), F.lower(r), F.lit("user"))
    out = F.lit(None).cast(_TURNS)
    for m in reversed(MAPPINGS):
        if not source.has(m):
            continue
        if m.row:
            turn, who, what = m.row
            turns = F.array(F.struct(source.number(turn).alias("turn"), source.field(who).alias("role"), source.field(what).alias("text")))
        elif m.items:
            name, role_field, text_field = m.items
            turns = F.transform(source.items(*m.items), lambda x, i: F.struct(i.cast("long").alias("turn"), role(x[role_field]).alias("role"), F.coalesce(x[text_field], F.lit("")).alias("text")))  # noqa: B023
        else:
            text = lambda ps: F.array_join(F.filter(F.array(*[F.coalesce(source.field(p), F.lit("")) for p in ps]), lambda x: x != ""), "\n")
            turns = F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), text(ps).alias("text")) for i, (r, ps) in enumerate(m.turns)])
        out = F.when(fingerprint(source.paths, m) == F.xxhash64(F.array(*map(F.lit, sorted(m.paths)))), turns.cast(_TURNS)).otherwise(out)
    return out


def canonical_turns(record: Column) -> Column:
    """array<struct<turn, role, text>> of a JSON record; null where no mapping has its fingerprint, or it isn't an object."""
    return _canonical(_Json(record))


def _turns_in(df: DataFrame, conv_id: str, record: str) -> Column:
    return _canonical(_Json(F.col(record)) if record in df.columns else _Columns(df, conv_id))


def turns_of(df: DataFrame, conv_id: str = "conv_id", record: str = "record") -> DataFrame:
    """(conv_id, turn, role, text) of a table in any layout that MAPPINGS know.

    A table with a column of JSON records has them in its rows; of any other, the columns are the fields. The fingerprint of the
    field paths selects the mapping, for turn rows (turn, role, text) as for conversations in one row. Lists of messages get their
    roles in lower case with the aliases of ROLES replaced. Turn rows keep role and text as they are, nulls too: an alias such as gpt, or
    Assistant, isn't the learned role there, as in the query's SQL. Rows whose fingerprint no mapping has give no turns;
    rejected() has them.
    """
    return df.select(F.col(conv_id).alias("conv_id"), F.explode(_turns_in(df, conv_id, record)).alias("x")).select("conv_id", "x.turn", "x.role", "x.text")


def rejected(df: DataFrame, conv_id: str = "conv_id", record: str = "record") -> DataFrame:
    """(conv_id, reason) of the rows that give turns_of() no turns: no mapping, or no turns in their list."""
    t = df.select(F.col(conv_id).alias("conv_id"), _turns_in(df, conv_id, record).alias("x"))
    return t.filter(F.coalesce(F.size("x"), F.lit(-1)) <= 0).select("conv_id", F.when(F.col("x").isNull(), "no mapping").otherwise("no turns").alias("reason"))


def escape(text: Column) -> Column:
    """Control strings get a backslash behind their first character, backslashes are doubled: unescape() restores any text."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(turns: DataFrame, *, learned: str = LEARNED_ROLE) -> DataFrame:
    """(conv_id, formatted, loss) of turns(conv_id, turn, role, text): one row for each conversation.

    formatted holds the turns by turn number (nulls first, ties by role and text), each as <|turn|>role<|text|>text<|end|> with role and
    text escaped; null roles and texts are empty. loss: array of (start, length) in code points of formatted, the escaped texts
    of the learned role. A null conv_id is a conversation of its own. Other columns are ignored; no rows, no result.
    """
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("body", escape(F.col("text"))).withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)))
    t = t.withColumn("piece", F.concat("head", "body", F.lit(END)))
    over = "over (partition by conv_id order by turn, role, text"
    t = t.withColumn("nth", F.expr(f"row_number() {over})")).withColumn("start", F.coalesce(F.expr(f"sum(char_length(piece)) {over} rows between unbounded preceding and 1 preceding)"), F.lit(0)) + F.char_length("head"))
    t = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("nth", "piece", F.when(F.col("role") == learned, F.struct("start", F.char_length("body").cast("long").alias("length"))).alias("learn")))).alias("x"))
    return t.select("conv_id", F.array_join("x.piece", "").alias("formatted"), F.filter("x.learn", lambda x: x.isNotNull()).alias("loss"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> from formatted text."""
    parts = F.filter(F.split(formatted, r"\Q<|end|>\E"), lambda x: x != "")
    cut = lambda x: F.split(F.substr(x, F.lit(len(TURN) + 1)), r"\Q<|text|>\E", 2)
    return F.transform(parts, lambda x: F.struct(unescape(cut(x)[0]).alias("role"), unescape(cut(x)[1]).alias("text")))


def masked_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, restored, one after the other."""
    return F.array_join(F.transform(loss, lambda x: unescape(F.substr(formatted, (x["start"] + 1).cast("int"), x["length"].cast("int")))), "")
