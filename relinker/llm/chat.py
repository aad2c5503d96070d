"""Chat formatting with DataFrame functions only: records of many layouts to canonical turns and one template.

A record is a VARIANT. The paths of its fields, as far as a layout knows them, are
hashed; the hash selects a layout, which says declaratively where turns, roles and
texts are. Turns are written with markers that texts cannot hold, as control strings in them are
escaped reversibly, and come with a loss mask over what the assistant says.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of nested fields that count.
DEEP = 3
#: Turns of a part; a longer conversation makes several rows.
PART = 64
_TURN = "struct<turn:bigint,role:string,text:string>"
_TURNS = f"array<{_TURN}>"
_NAMES = "array<string>"


@dataclass(frozen=True)
class Row:
    """The record is one turn of a conversation that has many rows; ``order`` ranks it."""

    order: str
    role: str
    text: str


@dataclass(frozen=True)
class Each:
    """A turn for each element of the list ``at``; ``text`` may be a list's ``field[].field``, which is joined."""

    at: str
    role: str
    text: str


@dataclass(frozen=True)
class One:
    """A turn of a fixed role whose text is that of ``fields``, blank lines between; none where all are absent or null."""

    role: str
    fields: tuple[str, ...]


@dataclass(frozen=True)
class Layout:
    """Where the turns of a record are. Fields of ``optional`` may be absent; roles are renamed by ``roles``."""

    name: str
    turns: tuple[Row | Each | One, ...]
    optional: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> set[str]:
        """All field paths that the layout reads."""
        out: set[str] = set()
        for t in self.turns:
            if isinstance(t, Row):
                out |= {f".{t.order}", f".{t.role}", f".{t.text}"}
            elif isinstance(t, Each):
                out |= {f".{t.at}[].{t.role}", f".{t.at}[].{t.text}"}
            else:
                out |= {f".{f}" for f in t.fields}
        return out

    def fingerprints(self) -> list[str]:
        """The sets of paths that it fits, each sorted and joined: all it needs, with any of the optional ones."""
        optional = sorted(f".{f}" for f in self.optional)
        need = self.paths() - set(optional)
        return [_joined(need | set(some)) for n in range(len(optional) + 1) for some in combinations(optional, n)]


def _joined(paths: set[str]) -> str:
    return "\n".join(sorted(paths))


SHARED = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
LAYOUTS = (
    Layout("turn rows", (Row("turn", "role", "text"),)),
    Layout("messages", (Each("messages", "role", "content"),)),
    Layout("message parts", (Each("messages", "role", "content[].text"),)),
    Layout("shared conversations", (Each("conversations", "from", "value"),), (), SHARED),
    Layout("instruction", (One("system", ("system",)), One("user", ("instruction", "input")), One("assistant", ("output",))), ("system", "input")),
    Layout("prompt and response", (One("system", ("system",)), One("user", ("prompt",)), One("assistant", ("response",))), ("system",)),
    Layout("prompt and completion", (One("user", ("prompt",)), One("assistant", ("completion",)))),
    Layout("message lists", (Each("prompt", "role", "content"), Each("completion", "role", "content"))),
    Layout("question and answer", (One("user", ("question",)), One("assistant", ("answer",)))),
)


def _get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def field_paths(value: Column, known: Sequence[str] | None = None, deep: int = DEEP) -> Column:
    """Sorted paths of a VARIANT's fields, ``.name`` for a field and ``[]`` for any element, ``deep`` fields down.

    With ``known``, only those. A list in a list ends its path; an empty list has none.
    """

    def walk(v: Column, levels: int) -> Column:
        items = _get(v, "$", "array<variant>")
        mark = F.when(items.isNull(), "").otherwise("[]")
        below = lambda e: walk(e["value"], levels - 1) if levels > 1 else F.array(F.lit(""))
        fields = lambda x: F.map_entries(_get(x, "$", "map<string,variant>"))
        named = lambda x: F.flatten(F.transform(fields(x), lambda e: F.transform(below(e), lambda p: F.concat(mark, F.lit("."), e["key"], p))))
        return F.array_distinct(F.flatten(F.transform(F.coalesce(items, F.array(v)), lambda x: F.coalesce(named(x), F.array(mark)))))

    found = walk(value, deep)
    if known is not None:
        names = F.lit(list(known))
        found = F.filter(found, lambda p: F.array_contains(names, p))
    return F.array_sort(found)


def fingerprint(value: Column, layouts: Sequence[Layout] = LAYOUTS) -> Column:
    """XXH64 of the field paths of a VARIANT that some layout knows."""
    known = sorted(set().union(*(x.paths() for x in layouts)))
    return F.xxhash64(F.array_join(field_paths(value, known), "\n"))


def _turns(v: Column, layout: Layout) -> Column:
    """Canonical turns of a record of this layout."""
    names = dict(layout.roles)

    def role(c: Column) -> Column:
        if names:
            pairs = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
            c = F.coalesce(F.element_at(pairs, c), c)
        return F.coalesce(c, F.lit(""))

    def turn(at: Column, who: Column, text: Column) -> Column:
        made = F.struct(at.cast("long").alias("turn"), role(who).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
        return made.cast(_TURN)

    out = []
    for t in layout.turns:
        if isinstance(t, Row):
            out.append(F.array(turn(*(_get(v, f"$.{p}", k) for p, k in ((t.order, "bigint"), (t.role, "string"), (t.text, "string"))))))
        elif isinstance(t, Each):
            lists, _, part = t.text.partition("[].")
            text = (lambda m: _get(m, f"$.{t.text}", "string")) if not part else (
                lambda m: F.array_join(F.transform(_get(m, f"$.{lists}", "array<variant>"), lambda x: F.coalesce(_get(x, f"$.{part}", "string"), F.lit(""))), "")
            )
            items = F.coalesce(_get(v, f"$.{t.at}", "array<variant>"), F.array().cast("array<variant>"))
            out.append(F.transform(items, lambda m, i: turn(i, _get(m, f"$.{t.role}", "string"), text(m))))
        else:
            texts = F.filter(F.array(*(_get(v, f"$.{f}", "string") for f in t.fields)), lambda x: x.isNotNull())
            filled = F.filter(texts, lambda x: x != "")
            one = F.array(turn(F.lit(0), F.lit(t.role), F.array_join(filled, "\n\n")))
            missing = F.array().cast(_TURNS) if set(t.fields) <= set(layout.optional) else one
            out.append(F.when(F.size(texts) > 0, one).otherwise(missing))
    return F.concat(*out)


def escape(text: Column) -> Column:
    """``text`` without markers: a backslash after each backslash and after the first sign of each marker."""
    return F.regexp_replace(text, r"\\|<(?=/?turn)|#(?=##)", "$0\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def template(turns: Column) -> Column:
    """``struct<formatted, loss>`` of turns: the text, and the places (code points, end exclusive) of assistants' texts in it."""
    spans = "array<struct<start:int,end:int>>"
    pieces = F.transform(turns, lambda t: F.struct(F.concat(F.lit("### "), escape(t["role"]), F.lit(": <turn>")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("own")))
    formatted = F.array_join(F.transform(pieces, lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        span = F.struct(start.alias("start"), end.alias("end"))
        return F.struct((end + len(END)).alias("at"), F.when(p["own"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.struct(formatted.alias("formatted"), F.aggregate(pieces, zero, step, lambda a: a["out"]).alias("loss"))


#: What ends a turn.
END = "</turn>\n"


def read_turns(formatted: Column) -> Column:
    """``array<struct<role, text>>``: what ``template`` wrote."""
    ended = F.split(formatted, END, -1)
    halves = F.transform(F.slice(ended, 1, F.size(ended) - 1), lambda t: F.split(t, ": <turn>", 2))
    return F.transform(halves, lambda h: F.struct(unescape(F.substring(h[0], 5, 2**31 - 1)).alias("role"), unescape(h[1]).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def canonical_turns(df: DataFrame, id_col: str = "conv_id", record_col: str = "record", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """``conv_id, layout, rows, turns`` of each record: the layout that its fingerprint selects (null without one) and its turns."""
    record = F.col(record_col)
    if dict(df.dtypes)[record_col] == "string":
        record = F.try_parse_json(record)
    seen = df.select(F.col(id_col).alias("conv_id"), record.alias("v"))
    seen = seen.withColumn("print", fingerprint(F.col("v"), layouts))
    prints: dict[str, Layout] = {}
    for layout in layouts:
        for text in layout.fingerprints():
            if prints.setdefault(text, layout) is not layout:
                raise ValueError(f"layouts {prints[text].name!r} and {layout.name!r} have the same fields")
    of = lambda layout: F.col("print").isin(*(F.xxhash64(F.lit(p)) for p, x in prints.items() if x is layout))
    chosen = lambda value: reduce(lambda c, x: c.when(of(x), value(x)), layouts[1:], F.when(of(layouts[0]), value(layouts[0])))
    return seen.select(
        "conv_id",
        chosen(lambda x: F.lit(x.name)).alias("layout"),
        F.coalesce(chosen(lambda x: F.lit(any(isinstance(t, Row) for t in x.turns))), F.lit(False)).alias("rows"),
        chosen(lambda x: _turns(F.col("v"), x)).alias("turns"),
    )


def format_chats(df: DataFrame, id_col: str = "conv_id", record_col: str = "record", *, layouts: Sequence[Layout] = LAYOUTS, part: int = PART) -> DataFrame:
    """``conv_id, layout, part, n_turns, formatted, loss`` of each conversation, in parts whose texts follow one another.

    ``record_col`` is VARIANT or JSON text. Records of a layout of turn rows are joined by
    ``id_col`` and ranked by their order (null first; ties by role, then text), in parts of ``part`` order
    numbers, so that a conversation of any length is no task of its own; any other
    record is a conversation, in parts of ``part`` turns. ``loss`` has the places of assistants'
    texts in ``formatted``. A null text or role is empty. A record whose fields fit no
    layout (an empty list has no fields), a null one and one that is no JSON have a null layout,
    0 turns and a null text. Null ids are a conversation's like any other; repeated rows
    repeat; fields and columns that no layout names are ignored; an empty table gives no rows.
    """
    seen = canonical_turns(df, id_col, record_col, layouts)
    at = F.col("turns")[0]["turn"]
    grouped = seen.filter("rows").select("conv_id", "layout", F.floor(at / part).cast("long").alias("part"), at.alias("at"), "turns")
    grouped = grouped.groupBy("conv_id", "layout", "part").agg(F.array_sort(F.flatten(F.collect_list("turns"))).alias("turns"))
    some = lambda i: F.struct(i.cast("long").alias("part"), F.slice("turns", i * part + 1, part).alias("turns"))
    last = F.floor(F.greatest(F.coalesce(F.size("turns"), F.lit(0)) - 1, F.lit(0)) / part).cast("int")
    whole = seen.filter("NOT rows").select("conv_id", "layout", F.explode(F.transform(F.sequence(F.lit(0), last), some)).alias("p"))
    both = grouped.unionByName(whole.select("conv_id", "layout", "p.part", "p.turns"))
    made = both.select("conv_id", "layout", "part", "turns", template(F.col("turns")).alias("t"))
    n = F.coalesce(F.size("turns"), F.lit(0)).cast("long")
    return made.select("conv_id", "layout", "part", n.alias("n_turns"), "t.formatted", F.when(F.col("layout").isNotNull(), F.col("t.loss")).alias("loss"))


def chat_digests(parts: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` read back from ``format_chats``'s rows.

    A hash of a conversation needs all its text in one row; parts are joined for that alone.
    """
    turns = F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = parts.select(
        "conv_id", "part", F.coalesce(F.size(read_turns(F.col("formatted"))), F.lit(0)).alias("n"), F.coalesce(turns, F.lit("")).alias("turns"),
        F.coalesce(read_loss(F.col("formatted"), F.col("loss")), F.lit("")).alias("loss"), F.coalesce(F.length("formatted"), F.lit(0)).alias("chars"),
    )
    each = read.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"), F.array_sort(F.collect_list(F.struct("part", "turns", "loss"))).alias("p"), F.sum("chars").alias("formatted_chars")
    )
    whole = lambda name: F.array_join(F.transform("p", lambda x: x[name]), "")
    return each.select(
        "conv_id", "n_turns", F.sha2(whole("turns"), 256).alias("turns_sha256"), F.length(whole("loss")).cast("long").alias("loss_chars"),
        F.sha2(whole("loss"), 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


def turn_records(df: DataFrame) -> DataFrame:
    """``conv_id, record`` of a table of turns ``conv_id, turn, role, text``: each row a record of its own."""
    return df.select("conv_id", F.to_variant_object(F.struct("turn", "role", "text")).alias("record"))
