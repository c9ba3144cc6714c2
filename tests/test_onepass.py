"""Fields by one parse against an XPath engine, path by path, and against a tree parser."""

import random
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from textloom.operators import extract, onepass

PATHS = {
    "direct": "/r/a/b",
    "deep": "/r//b",
    "under": "/r/a//c/b",
    "any": "/r/*/c",
    "some": "/r//c/*[self::a or self::b]",
    "union": "/r/b | /r/a//b | //c",
    "all": "/r/c//*",
    "twice": "/r//a//a",
}


def tree(rng, depth=0):
    name = "r" if depth == 0 else rng.choice("abcr")
    inner = "".join(rng.choice([f"t{rng.randrange(99)}", " ", "&amp;x", "<!-- c -->", "é", "<?p i?>"]) if rng.random() < 0.4 or depth > 5 else tree(rng, depth + 1) for _ in range(rng.randrange(4 if depth else 7)))
    return f'<{name} k="{depth}">{inner}</{name}>'


def test_against_xpath(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, tree(rng)) for i in range(300)], "doc_id long, xml string").withColumn("dtd_version", F.lit(1))
    got = onepass.read_fields(docs, {1: PATHS}, {1: {}})
    joined = lambda p: F.xpath("xml", F.lit(" | ".join(f"{x.strip()}/text()" for x in p.split(" | "))))
    for r in got.select("doc_id", "xml", "error", *[F.col(n) for n in PATHS], *[joined(p).alias(f"want_{n}") for n, p in PATHS.items()]).collect():
        assert r["error"] is None
        for n in PATHS:
            assert r[n] == r[f"want_{n}"], (n, r["xml"])


@pytest.mark.parametrize("version", [4, 2])
def test_fixed_paths_against_xpath(spark, version):
    """Every path of the patents over documents made of the names in these paths."""
    rng = random.Random(version)
    names = sorted({n for p in extract.PATHS[version].values() for one in p.split(" | ") for _, names in onepass.steps(one) for n in names or ()})
    chains = [[sorted(names) if names else ["x", "y"] for _, names in onepass.steps(one)] for p in extract.PATHS[version].values() for one in p.split(" | ")]

    def document():
        out = ""
        for chain in rng.sample(chains, 6):
            picked = [rng.choice(c) for c in chain]
            if rng.random() < 0.5 and len(picked) > 2:
                picked.insert(rng.randrange(2, len(picked)), rng.choice(names))
            body = picked[1:] or ["x"]
            out += "".join(f"<{x}>" for x in body) + f"v{rng.randrange(99)}" + "".join(f"</{x}>" for x in reversed(body))
        root = chains[0][0][0]
        return f"<{root}>{out}</{root}>"

    docs = spark.createDataFrame([(i, document()) for i in range(200)], "doc_id long, xml string").withColumn("dtd_version", F.lit(version))
    got = onepass.read_fields(docs, extract.PATHS, extract.SUBTREES)
    rows = got.select("*", *[extract._texts(p).alias(f"want_{n}") for n, p in extract.PATHS[version].items()]).collect()
    assert all(r[n] == r[f"want_{n}"] for r in rows for n in extract.PATHS[version])
    assert sum(len(r[n]) for r in rows for n in extract.PATHS[version]) > 200


def test_subtrees_as_a_tree_parser_gives_them():
    rng = random.Random(7)
    matcher = onepass.Matcher(PATHS)
    for _ in range(200):
        xml = tree(rng)
        _, found, error = onepass.read(xml, matcher, {"one": "a", "two": "c"})
        root = ElementTree.fromstring(xml)
        want = {n: ElementTree.tostring(node, encoding="unicode") for n, tag in (("one", "a"), ("two", "c")) if (node := root.find(tag)) is not None}
        assert error is None and found == want


def test_broken_and_null_documents(spark):
    rows = [(1, "<r><a><b>x</b></a></r>", 1), (2, "<r><a>", 1), (3, None, 1), (4, "<r/>", 9), (5, "", 1), (6, '<?xml version="1.0" encoding="latin-1"?><!DOCTYPE r [<!ENTITY z "q">]><r><a><b>é</b></a></r>', 1), (7, "<r>&z;</r>", 1)]
    got = {r["doc_id"]: r for r in onepass.read_fields(spark.createDataFrame(rows, "doc_id long, xml string, dtd_version int"), {1: PATHS}, {1: {"tree": "a"}}).collect()}
    assert got[1]["direct"] == ["x"] and got[1]["any"] == [] and got[1]["tree"] == "<a><b>x</b></a>"
    assert got[6]["direct"] == ["é"] and got[6]["error"] is None
    for i in (2, 5, 7):
        assert got[i]["error"] and got[i]["direct"] is None and got[i]["tree"] is None
    for i in (3, 4):
        assert got[i]["error"] is None and got[i]["direct"] is None


def test_states_are_few():
    matcher = onepass.Matcher(extract.PATHS[4])
    rng = random.Random(9)
    names = [n for p in extract.PATHS[4].values() for one in p.split(" | ") for _, names in onepass.steps(one) for n in names or ()]
    for _ in range(2000):
        state = 0
        for name in rng.choices(names, k=8):
            state = matcher.under(state, name)
    assert len(matcher.states) < 2000
