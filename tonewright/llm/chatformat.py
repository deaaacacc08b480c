"""Chat formatting: records of many layouts become turns, turns become marked text under a loss mask.

A layout is told by its fingerprint, the hash of the nested paths of those fields that any mapping names (`messages[].role`); other fields of
a record do not count.  The fingerprint selects a mapping, which only declares where turns stand.  Typed tables have one fingerprint, that of
their schema, and are converted by DataFrame functions; columns of JSON text may hold another layout in every row.

`formatted` marks each turn by the control strings of a template.  Inside texts and roles a backslash is doubled, and one is put behind
the first character of whatever would read as a control string, so no text can end its turn and `read_back` gives back exactly what
went in.  Each turn is formatted by itself: a conversation of any length is never gathered.

Defined results: null texts and roles are empty ones; an optional turn without a text is left out; JSON that can't be read has a null fingerprint, and
that of an unknown layout a null layout: either has one row without a turn, so nothing is lost; lone surrogates become U+FFFD; a typed table of an
unknown layout is an error; turns of equal number are ordered by their formatted text; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

#: What stands between the parts of a turn that is made of several fields.
BETWEEN = "\n\n"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Said:
    """A turn: its role, or with `told` the path of its role, and the paths whose texts it is made of."""

    role: str
    texts: tuple[str, ...]
    told: bool = False
    optional: bool = False


@dataclass(frozen=True)
class Each:
    """A turn for each item of an array: the paths of role and texts inside an item, and other names of roles."""

    array: str
    role: str
    texts: tuple[str, ...]
    names: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Layout:
    """How records of one layout are read; paths of `maybe` may be missing.  With `order` a record is one turn, numbered by that field."""

    name: str
    parts: tuple[Said | Each, ...]
    maybe: tuple[str, ...] = ()
    order: str | None = None

    def paths(self) -> set[str]:
        out = {self.order} if self.order else set()
        for p in self.parts:
            if isinstance(p, Each):
                out |= {f"{p.array}[].{x}" for x in (p.role, *p.texts)}
            else:
                out |= {*p.texts, *([p.role] if p.told else ())}
        return out

    def fingerprints(self) -> Iterator[str]:
        """One for each choice of the fields that may be missing."""
        whole = self.paths()
        for gone in chain.from_iterable(combinations(self.maybe, n) for n in range(len(self.maybe) + 1)):
            yield fingerprint(whole - set(gone))


SPEAKERS = (("human", "user"), ("gpt", "assistant"), ("model", "assistant"), ("bot", "assistant"))


def _asked(name: str, asked: str, answered: str) -> Layout:
    return Layout(name, (Said("system", ("system",), optional=True), Said("user", (asked,)), Said("assistant", (answered,))), ("system",))


LAYOUTS = (
    Layout("row", (Said("role", ("text",), told=True),), order="turn"),
    Layout("messages", (Said("system", ("system",), optional=True), Each("messages", "role", ("content", "content[].text"))), ("system", "messages[].content", "messages[].content[].text")),
    Layout("conversations", (Said("system", ("system",), optional=True), Each("conversations", "from", ("value",), SPEAKERS)), ("system",)),
    Layout("two_lists", (Each("prompt", "role", ("content",)), Each("completion", "role", ("content",)))),
    Layout("instruction", (Said("system", ("system",), optional=True), Said("user", ("instruction", "input")), Said("assistant", ("output",))), ("system", "input")),
    Layout("nested", (Said("user", ("data.question", "data.context")), Said("assistant", ("data.answers[].text",))), ("data.context",)),
    _asked("prompt_completion", "prompt", "completion"),
    _asked("prompt_response", "prompt", "response"),
    _asked("question_answer", "question", "answer"),
)


def fingerprint(paths: Iterable[str]) -> str:
    """16 hexadecimal digits for a set of paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _path(path: str) -> tuple[str, ...]:
    return tuple(path.replace("[]", ".[]").split("."))


def _tree(layouts: tuple[Layout, ...]) -> dict:
    """All named paths as nested dictionaries; the key None ends a path."""
    out: dict = {}
    for path in set().union(*(x.paths() for x in layouts)):
        at = out
        for step in _path(path):
            at = at.setdefault(step, {})
        at[None] = path
    return out


def _chosen(layouts: tuple[Layout, ...]) -> dict[str, Layout]:
    """By fingerprint; of layouts that look alike the first counts."""
    out: dict[str, Layout] = {}
    for x in layouts:
        for f in x.fingerprints():
            out.setdefault(f, x)
    return out


def value_paths(value, tree: dict) -> set[str]:
    """The named paths of a value read from JSON."""
    if isinstance(value, list):
        return set().union(*(value_paths(v, tree["[]"]) for v in value)) if "[]" in tree else set()
    if isinstance(value, dict):
        return set().union(*(value_paths(v, tree[k]) for k, v in value.items() if k in tree and k != "[]"))
    return {tree[None]} if None in tree else set()


def schema_paths(kind: DataType, tree: dict) -> set[str]:
    """The named paths of a type."""
    if isinstance(kind, ArrayType):
        return schema_paths(kind.elementType, tree["[]"]) if "[]" in tree else set()
    if isinstance(kind, StructType):
        return set().union(*(schema_paths(f.dataType, tree[f.name]) for f in kind if f.name in tree and f.name != "[]"))
    return {tree[None]} if None in tree and not isinstance(kind, MapType) else set()


def _clean(value) -> str:
    text = value if isinstance(value, str) else json.dumps(value)
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _leaves(value, path: tuple[str, ...]) -> list[str]:
    """The texts at a path, without nulls."""
    if not path:
        return [] if value is None or isinstance(value, (dict, list)) else [_clean(value)]
    if path[0] == "[]":
        return [x for v in value for x in _leaves(v, path[1:])] if isinstance(value, list) else []
    return _leaves(value.get(path[0]), path[1:]) if isinstance(value, dict) else []


def _said(value, texts: tuple[str, ...]) -> str | None:
    """Parts that are not empty, one after the other; None if there is none at all."""
    held = ["".join(x) for x in (_leaves(value, _path(p)) for p in texts) if x]
    return BETWEEN.join(x for x in held if x) if held else None


def record_turns(record: dict, layout: Layout) -> list[tuple[str, str]]:
    """(role, text) of a record's turns."""
    out = []
    for p in layout.parts:
        if isinstance(p, Said):
            text = _said(record, p.texts)
            if text is not None or not p.optional:
                out.append(("".join(_leaves(record, _path(p.role))) if p.told else p.role, text or ""))
            continue
        for item in _items(record, _path(p.array)):
            role = "".join(_leaves(item, _path(p.role)))
            out.append((dict(p.names).get(role, role), _said(item, p.texts) or ""))
    return out


def _items(value, path: tuple[str, ...]) -> list:
    for step in path:
        value = value.get(step) if isinstance(value, dict) else None
    return value if isinstance(value, list) else []


def json_turns(records: DataFrame, key: str = "conv_id", record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(key, turn, role, text, layout, fingerprint) of a column of JSON records; a record that no mapping fits has one row without a turn."""
    tree, chosen = _tree(layouts), _chosen(layouts)
    given = records.select(F.col(key).alias("key"), F.col(record).cast("string").alias("record"))
    shape = given.select("key").schema.add("turn", "long").add("role", "string").add("text", "string").add("layout", "string").add("fingerprint", "string")

    def read(text: str | None) -> list[tuple]:
        try:
            value = json.loads(text or "")
            print_ = fingerprint(value_paths(value, tree))
        except (ValueError, RecursionError):
            return [(None,) * 5]
        layout = chosen.get(print_)
        if layout is None:
            return [(None, None, None, None, print_)]
        turns = record_turns(value, layout)
        first = "".join(_leaves(value, _path(layout.order))) if layout.order else "0"
        number = int(first) if re.fullmatch(r"-?\d{1,18}", first) else None
        return [(None if number is None else number + n, role, said, layout.name, print_) for n, (role, said) in enumerate(turns)] or [(None, None, None, layout.name, print_)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), *[pa.string()] * 4]
        for b in batches:
            found, from_ = [], []
            for n, text in enumerate(b.column("record").to_pylist()):
                rows = read(text)
                found += rows
                from_ += [n] * len(rows)
            columns = [pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(from_, pa.int64())), *columns], names=shape.names)

    return given.mapInArrow(run, shape).withColumnRenamed("key", key)


def _column(at: Column, kind: DataType, path: tuple[str, ...]) -> Column:
    """The texts at a path of a typed column, as an array; null where there are none."""
    if not path:
        return F.array(at.cast("string"))
    if path[0] == "[]":
        return F.flatten(F.transform(at, lambda x: _column(x, kind.elementType, path[1:])))
    return _column(at.getField(path[0]), kind[path[0]].dataType, path[1:])


def _joined(at, schema: StructType, texts: tuple[str, ...], there: set[str], above: str = "") -> Column:
    """As `_said`, over those paths that the schema has."""
    held = []
    for p in texts:
        if above + p in there:
            first, *rest = _path(p)
            leaves = _column(at(first), schema[first].dataType, tuple(rest))
            kept = F.filter(leaves, lambda x: x.isNotNull())
            held.append(F.when(F.size(kept) > 0, F.array_join(kept, "")))
    return F.when(F.coalesce(*held).isNotNull(), F.array_join(F.filter(F.array(*held), lambda x: x != ""), BETWEEN)) if held else F.lit(None).cast("string")


def _item_turn(each: Each, kind: StructType, there: set[str]):
    """A function from an item of an array to its turn."""

    def turn(item: Column) -> Column:
        above, empty = f"{each.array}[].", F.lit("")
        role = F.coalesce(_joined(item.getField, kind, (each.role,), there, above), empty)
        for told, name in each.names:
            role = F.when(role == told, name).otherwise(role)
        return F.struct(role.alias("role"), F.coalesce(_joined(item.getField, kind, each.texts, there, above), empty).alias("text"))

    return turn


def frame_turns(rows: DataFrame, key: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(key, turn, role, text) of a typed table, by the mapping that its schema's fingerprint selects."""
    there = schema_paths(rows.schema, _tree(layouts))
    layout = _chosen(layouts).get(fingerprint(there))
    if layout is None:
        raise ValueError(f"no mapping for the fields {sorted(there)} (fingerprint {fingerprint(there)})")
    top, empty = lambda name: F.col(f"`{name}`"), F.lit("")
    blocks = []
    for p in layout.parts:
        if isinstance(p, Said):
            text = _joined(top, rows.schema, p.texts, there)
            role = F.coalesce(_joined(top, rows.schema, (p.role,), there), empty) if p.told else F.lit(p.role)
            turn = F.array(F.struct(role.alias("role"), F.coalesce(text, empty).alias("text")))
            blocks.append(F.when(text.isNull(), F.array().cast(TURNS)).otherwise(turn) if p.optional else turn)
            continue
        first, *rest = _path(p.array)
        items, kind = top(first), rows.schema[first].dataType
        for step in rest:
            items, kind = items.getField(step), kind[step].dataType
        blocks.append(F.coalesce(F.transform(items, _item_turn(p, kind.elementType, there)), F.array().cast(TURNS)))
    number = F.col(f"`{layout.order}`").cast("long") if layout.order else F.lit(0).cast("long")
    turns = rows.select(F.col(f"`{key}`").alias("_key"), number.alias("_number"), F.posexplode(F.concat(*blocks)).alias("_n", "_turn"))
    return turns.select(F.col("_key").alias(key), (F.col("_number") + F.col("_n")).alias("turn"), "_turn.role", "_turn.text")


@dataclass(frozen=True)
class Template:
    """What stands before and behind the text of a turn, by role; other roles are written out between the first two of `other`."""

    roles: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("[ANS] ", "</s>")})
    other: tuple[str, str, str] = ("[ROLE] ", " [/ROLE] ", " [/TURN]")
    #: What may not stand inside a text; further special tokens of a tokenizer can be added.
    controls: tuple[str, ...] = ("<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[ANS]", "[ROLE]", "[/ROLE]", "[/TURN]")

    def pattern(self) -> str:
        """Where a control string starts: its first character."""
        return "(?=" + "|".join(re.sub(r"([^\w<>])", r"\\\1", c) for c in self.controls) + ")([\\s\\S])"

    def escaped(self, text: Column) -> Column:
        return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), self.pattern(), "$1\\\\")

    def escape(self, text: str) -> str:
        return re.sub(self.pattern(), r"\1\\", text.replace("\\", "\\\\"))

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\([\s\S])", r"\1", text)

    def read_back(self, piece: str) -> tuple[str, str]:
        """(role, text) of a formatted turn."""
        for role, (before, behind) in self.roles.items():
            if piece.startswith(before):
                return role, self.unescape(piece[len(before) : piece.index(behind, len(before))])
        before, between, behind = self.other
        role, _, text = piece[len(before) :].partition(between)
        return self.unescape(role), self.unescape(text[: text.rindex(behind)])


def formatted(turns: DataFrame, template: Template | None = None, key: str = "conv_id", learn: str = "assistant") -> DataFrame:
    """(key, turn, formatted, loss_from, loss_chars): each turn's text with its marks, and the stretch of it that is learned (none: null).

    A conversation is its turns' texts one after the other; the mask covers the texts of the `learn` role, without marks.
    """
    template = template or Template()
    text, role = template.escaped(F.coalesce("text", F.lit(""))), F.coalesce("role", F.lit(""))
    named, between, behind = template.other
    before, after = F.concat(F.lit(named), template.escaped(role), F.lit(between)), F.lit(behind)
    for name, (left, right) in template.roles.items():
        before, after = F.when(role == name, left).otherwise(before), F.when(role == name, right).otherwise(after)
    parts = turns.select(F.col(key).alias("_key"), F.col("turn").alias("_turn"), role.alias("_role"), before.alias("_before"), text.alias("_text"), after.alias("_after"))
    learned = lambda c: F.when(F.col("_role") == learn, F.length(c)).cast("long")
    return parts.select(F.col("_key").alias(key), F.col("_turn").alias("turn"), F.concat("_before", "_text", "_after").alias("formatted"), learned("_before").alias("loss_from"), learned("_text").alias("loss_chars"))


def digests(pieces: DataFrame, template: Template | None = None, key: str = "conv_id") -> DataFrame:
    """What a conversation's formatted turns say, read back: turns, digests of turns and of all learned text, sizes.

    The turns stream through their task in order, sorted by Spark, which spills; the digests are made as they pass, so a conversation of
    any length takes the memory of a batch (its digest can't be made in more than one place).
    """
    template = template or Template()
    given = pieces.select(F.col(key).alias("key"), "turn", "formatted", "loss_from", "loss_chars")
    shape = given.select("key").schema.add("n_turns", "long").add("turns_sha256", "string").add("loss_chars", "long").add("loss_sha256", "string").add("formatted_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        held, keys, done = None, None, []  # held: the key, count, digest of turns, learned code points, digest of these, size

        def flush():
            rows = [(r[1], r[2].hexdigest(), r[3], r[4].hexdigest(), r[5]) for r in done]
            columns = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(kinds)]
            out = pa.RecordBatch.from_arrays([pa.array([r[0] for r in done], keys), *columns], names=shape.names)
            done.clear()
            return out

        for b in batches:
            keys = b.column("key").type
            for k, piece, from_, size in zip(*(b.column(c).to_pylist() for c in ("key", "formatted", "loss_from", "loss_chars")), strict=True):
                if held is None or held[0] != k:
                    done += [held] if held else []
                    held = [k, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = template.read_back(piece)
                held[1] += 1
                held[2].update(f"{role}\n{text}\n".encode())
                if from_ is not None:
                    learned = template.unescape(piece[from_ : from_ + size])
                    held[3] += len(learned)
                    held[4].update(learned.encode())
                held[5] += len(piece)
            if len(done) >= 1000:
                yield flush()
        done += [held] if held else []
        if done:
            yield flush()

    ordered = given.repartition("key").sortWithinPartitions("key", "turn", "formatted")
    return ordered.mapInArrow(run, shape).withColumnRenamed("key", key)
