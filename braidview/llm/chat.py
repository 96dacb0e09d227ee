"""Chat formatting with linked tool calls.

A turn's text may hold tool declarations, calls and results as JSON between tags: ``<tools>[{"name", "parameters"}]</tools>``,
``<tool_call>{"id", "name", "arguments", "after"}</tool_call>``, ``<tool_result>{"id", "content"}</tool_result>``. Calls and results of a conversation are hash-joined by
identifier (the n-th call of an id with its n-th result). Calls are put in topological order: a call comes after those that it names in ``after`` or refers to by an argument
"$id"; among free ones the earlier in the conversation is first. Arguments are validated against the declared schema (type, enum, const, required, properties,
additionalProperties, minProperties, maxProperties, items, minItems, maxItems, uniqueItems, minimum, maximum, exclusiveMinimum, exclusiveMaximum, multipleOf, minLength,
maxLength, pattern, allOf, anyOf, oneOf, not; annotations and unknown words constrain nothing). Every turn becomes one canonical JSON object: sorted keys, no spaces, letters as they are.

Calls and declarations are joined by name for validation. For the order alone the calls of a conversation are gathered in one task, each with its id and the ids that it
needs (some hundred bytes, no texts or arguments): a conversation may have as many calls as fit there, some millions; its turns, texts and results have no such bound.

Defined cases. Null texts are empty, null roles stay null. A null ``conv_id`` is a conversation of its own name; repeated rows are formatted each and their calls counted once.
Ids are compared by their text (a number by its JSON). Of several declarations of a name the last one counts, in the whole conversation.
A tag that isn't sound JSON stays in the content and counts in ``n_bad``: text that can't be read, NaN and numbers beyond a double's range, surrogates without their other half, more than ``DEPTH`` levels,
or a call, result or declaration without its name or id. Of equal keys in an object the last one counts. Calls on or behind a cycle come last, in order of appearance, with ``order`` null. Calls without a
declaration, or with one whose schema has a keyword of the wrong kind or a constraint that isn't among those above, are ``valid`` null; so are those for which a
``pattern`` takes longer than ``PATTERN_SECONDS``. Only ``conv_id``, ``turn``, ``role`` and ``text`` are read.
"""

from __future__ import annotations

import heapq
import json
import math
import re
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored

OPENING = re.compile(r"<(tools|tool_call|tool_result)>")
DEPTH = 100
_ENTRY = "k1 long, k2 long, conv string, turn long, seq int, kind string, id string, name string, body string, needs array<string>"


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def sound(text: str) -> object:
    """The value of a JSON text; ``ValueError`` if it can't be read, nests too deep, or holds what UTF-8 or a double can't."""
    try:
        value = json.loads(text, parse_constant=_no_constant)
    except RecursionError as e:
        raise ValueError("nested too deep") from e
    open_: list[tuple[object, int]] = [(value, 0)]
    while open_:
        x, depth = open_.pop()
        if depth > DEPTH:
            raise ValueError("nested too deep")
        if isinstance(x, dict):
            open_ += [(y, depth + 1) for pair in x.items() for y in pair]
        elif isinstance(x, list):
            open_ += [(y, depth + 1) for y in x]
        elif isinstance(x, str):
            x.encode()  # UnicodeEncodeError is a ValueError
        elif isinstance(x, float) and not math.isfinite(x):
            raise ValueError("a number is out of range")
    return value


def _entry(kind: str, value: object) -> bool:
    """Whether a value is what its tag promises."""
    if kind == "tools":
        return isinstance(value, list) and all(isinstance(x, dict) and isinstance(x.get("name"), str) for x in value)
    return isinstance(value, dict) and "id" in value and (kind == "tool_result" or isinstance(value.get("name"), str))


def parse(text: str | None) -> tuple[str, list[tuple[str, object]], int]:
    """The content without readable tags, the entries (kind, object) in order, and how many tags couldn't be read."""
    text = text or ""
    entries, bad, kept, since, at = [], 0, [], 0, 0
    unclosed: set[str] = set()
    while m := OPENING.search(text, at):
        kind, at = m[1], m.end()
        close = -1 if kind in unclosed else text.find(f"</{kind}>", at)
        if close < 0:
            unclosed.add(kind)
            continue
        inside, at = text[at:close], close + len(kind) + 3
        try:
            value = sound(inside)
            ok = _entry(kind, value)
        except ValueError:
            ok = False
        if ok:
            entries.append((kind, value))
            kept.append(text[since : m.start()])
            since = at
        else:
            bad += 1
    return "".join([*kept, text[since:]]).strip(), entries, bad


def _name(value: object) -> str:
    return value if isinstance(value, str) else canonical(value)


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _number(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _is(value: object, kind: str) -> bool:
    if kind in ("number", "integer"):
        return _number(value) and (kind == "number" or isinstance(value, int) or value.is_integer())
    return isinstance(value, _TYPES[kind])


def _same(a: object, b: object) -> bool:
    """Equality of JSON values: 1 is 1.0, but not true."""
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(v, b[k]) for k, v in a.items())
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    return isinstance(a, bool) == isinstance(b, bool) and a == b


# Words of JSON Schema that constrain a value and aren't read here.
UNREAD = frozenset(
    """
    $ref $dynamicRef $recursiveRef if then else patternProperties propertyNames contains minContains maxContains prefixItems additionalItems unevaluatedItems unevaluatedProperties
    dependentRequired dependentSchemas dependencies
    """.split()
)
COUNTS = ("minLength", "maxLength", "minItems", "maxItems", "minProperties", "maxProperties")
BOUNDS = ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum")
PATTERN_SECONDS = 2.0


class Undecided(Exception):
    """Whether a value fits can't be told."""


@lru_cache(maxsize=1_000)
def _pattern(text: str) -> regex.Pattern | None:
    try:
        return regex.compile(text)
    except regex.error:
        return None


def _whole(x: object) -> object:
    """Numbers that are whole as integers, so that equal values have one form."""
    if isinstance(x, dict):
        return {k: _whole(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_whole(v) for v in x]
    return int(x) if isinstance(x, float) and x.is_integer() else x


def usable(schema: object) -> bool:
    """Whether :func:`valid` reads all constraints of a schema, and these are of the kinds that they have to be."""
    if not isinstance(schema, dict):
        return isinstance(schema, bool)
    kinds = schema.get("type", [])
    names = [kinds] if isinstance(kinds, str) else kinds
    several = [schema[k] for k in ("allOf", "anyOf", "oneOf") if k in schema]
    return (
        not UNREAD & schema.keys() and all(isinstance(x, list) and x and all(map(usable, x)) for x in several) and usable(schema.get("not", True))
        and (isinstance(schema.get("pattern", ""), str) and _pattern(schema.get("pattern", "")) is not None) and isinstance(schema.get("uniqueItems", False), bool)
        and _number(schema.get("multipleOf", 1)) and schema.get("multipleOf", 1) > 0
        and isinstance(names, list) and (names != [] or "type" not in schema) and all(isinstance(k, str) and (k in _TYPES or k in ("number", "integer")) for k in names)
        and isinstance(schema.get("enum", []), list)
        and isinstance(schema.get("required", []), list) and all(isinstance(k, str) for k in schema.get("required", []))
        and isinstance(schema.get("properties", {}), dict) and all(map(usable, schema.get("properties", {}).values()))
        and usable(schema.get("additionalProperties", True)) and usable(schema.get("items", True))
        and all(_number(schema.get(k, 0)) for k in BOUNDS) and all(_is(schema.get(k, 0), "integer") for k in COUNTS)
    )


def _sized(n: int, schema: dict, least: str, most: str) -> bool:
    return schema.get(least, 0) <= n <= schema.get(most, n)


def valid(value: object, schema: object) -> bool:
    """Whether a value fits a usable schema; :class:`Undecided` if a pattern takes too long."""
    if isinstance(schema, bool):
        return schema
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return False
    if "enum" in schema and not any(_same(value, x) for x in schema["enum"]):
        return False
    if "const" in schema and not _same(value, schema["const"]):
        return False
    if not all(valid(value, x) for x in schema.get("allOf", [])) or ("anyOf" in schema and not any(valid(value, x) for x in schema["anyOf"])):
        return False
    if ("oneOf" in schema and sum(valid(value, x) for x in schema["oneOf"]) != 1) or ("not" in schema and valid(value, schema["not"])):
        return False
    if isinstance(value, dict):
        known = schema.get("properties", {})
        if any(k not in value for k in schema.get("required", [])) or any(k in value and not valid(value[k], s) for k, s in known.items()):
            return False
        return _sized(len(value), schema, "minProperties", "maxProperties") and all(valid(v, schema.get("additionalProperties", True)) for k, v in value.items() if k not in known)
    if isinstance(value, list):
        if not _sized(len(value), schema, "minItems", "maxItems") or (schema.get("uniqueItems") and len({canonical(_whole(x)) for x in value}) < len(value)):
            return False
        return all(valid(v, schema.get("items", True)) for v in value)
    if isinstance(value, str):
        if not _sized(len(value), schema, "minLength", "maxLength"):
            return False
        try:
            return "pattern" not in schema or _pattern(schema["pattern"]).search(value, timeout=PATTERN_SECONDS) is not None
        except TimeoutError as e:
            raise Undecided from e
    if not _number(value):
        return True
    if not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        return False
    if ("exclusiveMinimum" in schema and value <= schema["exclusiveMinimum"]) or ("exclusiveMaximum" in schema and value >= schema["exclusiveMaximum"]):
        return False
    return "multipleOf" not in schema or Fraction(str(value)) % Fraction(str(schema["multipleOf"])) == 0


def verdict(value: object, schema: object) -> bool | None:
    """Whether a value fits a schema, or null if that can't be told."""
    try:
        return valid(value, schema) if usable(schema) else None
    except Undecided:
        return None


def references(value: object) -> set[str]:
    """Ids that arguments refer to as "$id"."""
    if isinstance(value, str):
        return {value[1:]} if value.startswith("$") else set()
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return set().union(*map(references, inner))


def topological(calls: list[tuple[str, set[str]]]) -> list[int | None]:
    """Places (from 0) of calls given in order of appearance with the ids that each needs; None on or behind a cycle. An id stands for its first call."""
    first: dict[str, int] = {}
    for i, (name, _) in enumerate(calls):
        first.setdefault(name, i)
    needs = [{first[d] for d in deps if d in first and first[d] != i} | ({i} if calls[i][0] in deps and first[calls[i][0]] == i else set()) for i, (_, deps) in enumerate(calls)]
    behind: dict[int, list[int]] = {}
    for i, n in enumerate(needs):
        for j in n:
            behind.setdefault(j, []).append(i)
    open_, free, out, place = [len(n) for n in needs], [i for i, n in enumerate(needs) if not n], [None] * len(calls), 0
    heapq.heapify(free)
    while free:
        i = heapq.heappop(free)
        out[i], place = place, place + 1
        for j in behind.get(i, ()):
            open_[j] -= 1
            if not open_[j]:
                heapq.heappush(free, j)
    return out


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per call and result, and per name that a tag declares: a call's arguments and the ids that it needs, a declaration's schema."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("conv", pa.string()), ("turn", pa.int64()), ("seq", pa.int32()), *[(c, pa.string()) for c in ("kind", "id", "name", "body")], ("needs", pa.list_(pa.string()))])
    for batch in batches:
        rows = []
        for k1, k2, conv, turn, text in zip(*(c.to_pylist() for c in batch.columns)):
            for seq, (kind, value) in enumerate(parse(text)[1]):
                place = (k1, k2, conv, turn, seq, kind)
                if kind == "tools":
                    rows += [(*place, None, name, canonical(x.get("parameters", {})), None) for name, x in {x["name"]: x for x in value}.items()]
                elif kind == "tool_call":
                    after, arguments = value.get("after"), value.get("arguments", {})
                    needs = set(map(_name, after)) if isinstance(after, list) else set()
                    rows.append((*place, _name(value["id"]), value["name"], canonical(arguments), sorted(needs | references(arguments))))
                else:
                    rows.append((*place, _name(value["id"]), None, None, None))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether arguments fit the schema beside them; null without a usable one."""
    for batch in batches:
        said = []
        for body, declared in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            schema = None if declared is None else json.loads(declared)
            said.append(verdict(json.loads(body), schema) if declared is not None else None)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(said, pa.bool_())], names=["k1", "k2", "seq", "valid"])


def _arrange(part: pd.DataFrame) -> pd.DataFrame:
    """The order of a conversation's calls."""
    part = part.sort_values(["turn", "k1", "k2", "seq"], kind="stable", na_position="first")
    out = part[["k1", "k2", "seq"]].copy()
    out["order"] = pd.array(topological([(i, set(n)) for i, n in zip(part["id"], part["needs"])]), dtype="Int64")
    return out


def _keys(turns: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    conv = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), text.alias("text"), conv.alias("conv"))
    own = [F.xxhash64(F.lit(s), "conv", F.coalesce("turn", F.lit(-1)), F.coalesce("role", F.lit("")), "text") for s in (17, 23)]
    return rows.select(own[0].alias("k1"), own[1].alias("k2"), "*")


def format_turns(turns: DataFrame) -> DataFrame:
    """``conv_id turn role message n_calls n_linked n_invalid n_results n_bad`` of every row."""
    rows = small_batches(_keys(turns))
    entries = rows.select("k1", "k2", "conv", "turn", "text").mapInArrow(_entries, _ENTRY)
    entries = stored(entries.dropDuplicates(["k1", "k2", "seq", "name"]), "entries")  # texts are read once for them
    nth = F.row_number().over(Window.partitionBy("conv", "id", "kind").orderBy("turn", "k1", "k2", "seq"))
    both = entries.where("kind <> 'tools'").select("k1", "k2", "conv", "turn", "seq", "kind", "id").withColumn("n", nth)
    calls = both.where("kind = 'tool_call'").select("k1", "k2", "conv", "turn", "seq", "id", "n")
    results = both.where("kind = 'tool_result'").select(F.col("k1").alias("r1"), F.col("k2").alias("r2"), "conv", F.col("turn").alias("result_turn"), F.col("seq").alias("result_seq"), "id", "n")
    linked = calls.hint("shuffle_hash").join(results, ["conv", "id", "n"], "full_outer")
    own = entries.where("kind = 'tool_call'")
    arranged = own.select("conv", "turn", "k1", "k2", "seq", "id", "needs").groupBy("conv").applyInPandas(_arrange, "k1 long, k2 long, seq int, order long")
    declared = entries.where("kind = 'tools'").groupBy("conv", "name").agg(F.max(F.struct("turn", "k1", "k2", "seq", "body"))["body"].alias("declared"))
    judged = own.join(declared, ["conv", "name"], "left").select("k1", "k2", "seq", "body", "declared").mapInArrow(_judge, "k1 long, k2 long, seq int, valid boolean")
    told = linked.where("k1 is not null").join(arranged, ["k1", "k2", "seq"], "left").join(judged, ["k1", "k2", "seq"], "left")
    of_calls = told.select("k1", "k2", "seq", F.lit("c").alias("kind"), "order", "valid", F.col("result_turn").alias("other"), F.col("r1").isNotNull().alias("linked"))
    of_results = linked.where("r1 is not null").select(
        F.col("r1").alias("k1"), F.col("r2").alias("k2"), F.col("result_seq").alias("seq"), F.lit("r").alias("kind"), F.lit(None).cast("long").alias("order"), F.lit(None).cast("boolean").alias("valid"),
        F.col("turn").alias("other"), F.col("k1").isNotNull().alias("linked"),
    )
    links = of_calls.unionByName(of_results).groupBy("k1", "k2").agg(F.collect_list(F.struct("seq", "order", "valid", "other", "linked")).alias("links"))
    full = rows.join(links, ["k1", "k2"], "left").select("conv_id", "turn", "role", "text", "links")
    return full.mapInArrow(_format, "conv_id long, turn long, role string, message string, n_calls long, n_linked long, n_invalid long, n_results long, n_bad long")


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "turn", "role", "message", "n_calls", "n_linked", "n_invalid", "n_results", "n_bad"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 5]
    for batch in batches:
        out = []
        for conv_id, turn, role, text, links in zip(*(c.to_pylist() for c in batch.columns)):
            content, entries, bad = parse(text)
            found = {x["seq"]: x for x in links or ()}
            message = {"content": content, "conversation": conv_id, "role": role, "turn": turn}
            calls, results, tools = [], [], []
            for seq, (kind, value) in enumerate(entries):
                x = found.get(seq)
                if kind == "tools":
                    tools += value
                elif kind == "tool_call":
                    calls.append({"arguments": value.get("arguments", {}), "id": value["id"], "name": value["name"], "order": x["order"], "result_turn": x["other"], "valid": x["valid"]})
                else:
                    results.append({"call_turn": x["other"], "content": value.get("content"), "id": value["id"], "linked": x["linked"]})
            message |= {k: v for k, v in (("tool_calls", calls), ("tool_results", results), ("tools", tools)) if v}
            n_linked = sum(bool(found[s]["linked"]) for s, (kind, _) in enumerate(entries) if kind == "tool_call")
            out.append((conv_id, turn, role, canonical(message), len(calls), n_linked, sum(c["valid"] is False for c in calls), len(results), bad))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


query = format_turns
