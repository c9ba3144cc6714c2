"""All fields of a document by one parse: a trie of their paths, run over the parser's events.

Paths are made of child and descendant steps with a name, any name, or one of several names.  They share a trie; the
nodes of it that an element reaches are a state, and states are worked out once for each name that is met under them, so
that an element costs one lookup whatever the number of fields.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from xml.etree import ElementTree
from xml.parsers import expat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of documents that a task answers for at once, and transitions that it remembers.
PART_BYTES, REMEMBERED = 8 << 20, 100_000


class Node:
    """A place in the trie: steps (descendant or child, names or None for any) to further places, and the fields that end."""

    def __init__(self):
        self.steps: dict[tuple[bool, frozenset | None], Node] = {}
        self.fields: list[str] = []


def steps(path: str) -> list[tuple[bool, frozenset | None]]:
    """`/a//b/*[self::c or self::d]` as steps."""
    found = []
    for axis, test in re.findall(r"(//|/)(\*\[[^\]]*\]|\*|[\w.-]+)", path):
        names = None if test == "*" else frozenset(re.findall(r"self::([\w.-]+)", test)) if test[0] == "*" else frozenset([test])
        found.append((axis == "//", names))
    return found


class Matcher:
    """Which fields an element at a path of names belongs to, state by state."""

    def __init__(self, paths: dict[str, str]):
        root = Node()
        for name, several in paths.items():
            for path in several.split(" | "):
                node = root
                for step in steps(path.strip()):
                    node = node.steps.setdefault(step, Node())
                if name not in node.fields:
                    node.fields.append(name)
        # a state: nodes just reached, and nodes further up whose descendant steps go on
        self.states, self.fields = [((root,), (root,))], [()]
        self.ids: dict[tuple, int] = {}
        self.known: dict[tuple[int, str], int] = {}

    def under(self, state: int, name: str) -> int:
        """The state of an element called `name` under one in `state`."""
        key = state, name
        if (found := self.known.get(key)) is not None:
            return found
        here, above = self.states[state]
        fits = lambda names: names is None or name in names
        reached = [node for at in here for (deep, names), node in at.steps.items() if not deep and fits(names)]
        reached += [node for at in above for (deep, names), node in at.steps.items() if deep and fits(names)]
        reached = tuple(dict.fromkeys(reached))
        above = tuple(dict.fromkeys([*above, *(n for n in reached if any(deep for deep, _ in n.steps))]))
        if (found := self.ids.get((reached, above))) is None:
            found = self.ids[reached, above] = len(self.states)
            self.states.append((reached, above))
            self.fields.append(tuple(dict.fromkeys(f for n in reached for f in n.fields)))
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[key] = found
        return found


def read(xml: str, matcher: Matcher, subtrees: dict[str, str]) -> tuple[dict[str, list[str]], dict[str, str], str | None]:
    """(texts of each field in the order of the document, subtrees as XML, error).  A subtree is the first child of the root
    with its name; a document that cannot be parsed has an error and nothing else."""
    found: dict[str, list[str]] = {}
    trees: dict[str, str] = {}
    stack, held = [0], []
    builder = waiting = None  # the subtree that is open; the one that may still get text behind it
    tags = {tag: name for name, tag in subtrees.items()}

    def text() -> None:
        if held:
            for f in matcher.fields[stack[-1]]:
                found.setdefault(f, []).append("".join(held))
            held.clear()

    def settle() -> None:
        nonlocal waiting
        if waiting is not None:
            name, node, tail = waiting
            node.tail = "".join(tail) or None
            trees[name] = ElementTree.tostring(node, encoding="unicode")
            waiting = None

    def start(tag: str, attributes: dict) -> None:
        nonlocal builder
        text()
        settle()
        stack.append(matcher.under(stack[-1], tag))
        if builder is None and len(stack) == 3 and tag in tags and tags[tag] not in trees:
            builder = ElementTree.TreeBuilder()
        if builder is not None:
            builder.start(tag, attributes)

    def end(tag: str) -> None:
        nonlocal builder, waiting
        text()
        settle()
        stack.pop()
        if builder is not None:
            builder.end(tag)
            if len(stack) == 2:
                waiting, builder = (tags[tag], builder.close(), []), None

    def data(piece: str) -> None:
        held.append(piece)
        if builder is not None:
            builder.data(piece)
        elif waiting is not None:
            waiting[2].append(piece)

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    parser.CommentHandler = parser.ProcessingInstructionHandler = lambda *_: text()  # they part text from text
    try:
        parser.Parse(re.sub(r"<!DOCTYPE[^>\[]*(\[[^\]]*\])?>", "", re.sub(r"^\s*<\?xml[^>]*\?>", "", xml)).encode(), True)
    except (expat.ExpatError, UnicodeEncodeError) as e:
        return {}, {}, str(e)
    return found, trees, None


@lru_cache(8)
def _matcher(paths: tuple[tuple[str, str], ...]) -> Matcher:
    return Matcher(dict(paths))


def read_fields(rows: DataFrame, paths: dict[int, dict[str, str]], subtrees: dict[int, dict[str, str]]) -> DataFrame:
    """`rows` (xml, dtd_version, ...) with an array of texts for each field, a string for each subtree, and `error`.

    A field without a match has an empty array.  A null document, or one of a version without paths, has nulls and no
    error.  Columns of the fields' own names must not be there before."""
    fields, trees = list(dict.fromkeys(f for p in paths.values() for f in p)), list(dict.fromkeys(f for p in subtrees.values() for f in p))
    frozen = {v: tuple(p.items()) for v, p in paths.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column("xml")), 0))
            part = np.cumsum(sizes) // PART_BYTES
            edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                yield answer(batch.slice(a, b - a))

    def answer(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = {name: [] for name in (*fields, *trees, "error")}
        for xml, version in zip(batch.column("xml").to_pylist(), batch.column("dtd_version").to_pylist(), strict=True):
            known = xml is not None and version in frozen
            texts, cut, error = read(xml, _matcher(frozen[version]), subtrees[version]) if known else ({}, {}, None)
            for name in fields:
                out[name].append(texts.get(name, []) if known and error is None else None)
            for name in trees:
                out[name].append(cut.get(name))
            out["error"].append(error)
        kinds = [pa.list_(pa.string())] * len(fields) + [pa.string()] * (len(trees) + 1)
        return pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)]], [*batch.schema.names, *out])

    schema = T.StructType(list(rows.schema.fields))
    for name in fields:
        schema = schema.add(name, T.ArrayType(T.StringType()))
    for name in (*trees, "error"):
        schema = schema.add(name, "string")
    return rows.mapInArrow(run, schema)
