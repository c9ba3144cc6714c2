"""Parts of documents and fixed-length sequences of part vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

#: Parts of each field at level 3.
PART_COUNTS = {"abstract": 3, "description": 23, "claims": 4}


def chunk_of(position: Column, n: Column, parts: int) -> Column:
    """The chunk of a 0-based position among n; all in the first if there are fewer than `parts`."""
    return F.when(n < parts, 0).otherwise(F.least(F.expr("1") * F.floor(position / F.greatest(F.floor(n / parts), F.lit(1))), F.lit(parts - 1)))


def chunks(tokens: Column, parts: int) -> Column:
    """An array of `parts` arrays; the tokens are made once."""

    def cut(t: Column) -> Column:
        size = F.floor(F.size(t) / parts).cast("int")

        def one(i: int) -> Column:
            length = F.when(size == 0, F.size(t) if i == 0 else 0).otherwise(F.size(t) - i * size if i == parts - 1 else size)
            return F.slice(t, F.lit(i) * size + 1, length)

        return F.array(*[one(i) for i in range(parts)])

    return let(tokens, cut)


def level_parts(rows: DataFrame) -> DataFrame:
    """(doc_id, level, part_name, part_no, tokens) of rows (doc_id, abstract, description, claims), token arrays.

    All parts of a document are cut from one reading of its tokens."""

    def part(level: int, name: str | None, no: Column, tokens: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), F.lit(name).cast("string").alias("part_name"), no.cast("int").alias("part_no"), tokens.alias("tokens"))

    def third(name: str, tokens: Column) -> Column:
        return F.transform(chunks(tokens, PART_COUNTS[name]), lambda t, i: part(3, name, i + 1, t))

    def every(fields: Column) -> Column:
        own = {name: fields[name] for name in PART_COUNTS}
        none = F.lit(None)
        upper = F.array(part(1, None, none, F.concat(*own.values())), *[part(2, name, none, t) for name, t in own.items()])
        return F.concat(upper, *[third(name, t) for name, t in own.items()])

    return rows.select("doc_id", F.inline(let(F.struct(*PART_COUNTS), every)))


def slots(level: int) -> list[tuple[int, str, int, int]]:
    """H2-H4: (level, name, part number, slot) in the order of the sequence, up to a level."""
    wanted = [(1, "document", 0)]
    for name, n in PART_COUNTS.items() if level > 1 else ():
        wanted.append((2, name, 0))
        wanted += [(3, name, i) for i in range(1, n + 1)] if level > 2 else []
    return [(*x, slot) for slot, x in enumerate(wanted)]


def assemble(vectors: DataFrame, size: int, width: int) -> DataFrame:
    """H1, H5, H6: (doc_id, seq) of rows (doc_id, slot, vec): `size` vectors in order of slots, zeros where missing.

    A map from slot to vector for each document replaces the cross join of documents and slots; its size is fixed."""
    gathered = vectors.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "vec"))).alias("m"))
    zero = F.array_repeat(F.lit(0.0).cast("float"), width)
    return gathered.select("doc_id", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), zero)).alias("seq"))


def sequences_of_level(vectors: DataFrame, level: int, width: int) -> DataFrame:
    """H2-H6: (doc_id, seq) of rows (doc_id, level, part_name, part_no, vec): 1, 4 or 34 vectors of a document.

    The slot is a literal map from the part, so nothing is joined."""
    places = F.create_map(*[F.lit(x) for n, name, no, slot in slots(level) for x in (f"{n}/{name}/{no}", slot)])
    part = F.concat_ws("/", F.col("level").cast("string"), F.coalesce("part_name", F.lit("document")), F.coalesce("part_no", F.lit(0)).cast("string"))
    placed = vectors.select("doc_id", F.try_element_at(places, part).alias("slot"), "vec").where("slot is not null")
    return assemble(placed, len(slots(level)), width)


def flattened(sequences: DataFrame) -> DataFrame:
    """H8."""
    return sequences.select("doc_id", F.flatten("seq").alias("flat"))


def is_real_doc(part_id: Column) -> Column:
    """P16."""
    return F.instr(part_id, "_") == 0


def is_wanted_part(part_id: Column, level: int, name: str = "") -> Column:
    """As many pieces as the level, and the same first letter."""
    pieces = F.split(part_id, "_")
    fits = F.size(pieces) == level
    return fits if level == 1 else fits & (F.substring(F.get(pieces, F.lit(1)), 1, 1) == name[:1])


def sentences_of(tokens: Column, longest: int = 10_000) -> Column:
    """Pieces of at most `longest` tokens."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1)), F.lit(longest))
    return F.transform(starts, lambda s: F.slice(tokens, s, longest))
