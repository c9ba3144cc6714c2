"""Edge cases of every operator against brute force: nulls, empty and long texts, ties, repeats, empty tables, clashes."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import bpe, exact_dedup, license_scan, line_dedup, minhash_dedup, mixing, quality, substring_dedup, suffix_dedup, vector_dedup
from textloom.llm.common import KeyFilter, clean, components, materialize, shared_folder

from . import helpers as H


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (300, 200), (300, 400), (7, 7)]
    found = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | dict.fromkeys((100, 200, 300, 400), 100)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_license_scan(spark):
    rows = H.edge_rows()
    found = license_scan.license_scan(H.frame(spark)).collect()
    assert len(found) == len(rows)
    got = {r["doc_id"]: r for r in found}
    one = got[18]
    assert one["n_words"] == 17 and one["n_base"] == 5 and one["first_word"] == 2 and one["last_word"] == 15
    assert one["base_labels"] == "cc-by,gpl,reserved" and one["score"] == 1.0
    assert got[19]["labels"] == "mit" and got[19]["base_labels"] == "" and got[19]["score"] == pytest.approx(1.0)
    assert got[5]["n_words"] == 0 and got[5]["labels"] == "" and got[5]["first_word"] is None
    for i, text, *_ in rows:
        if i not in (None, 18):
            own = [w for w in license_scan.words_of((text or "").encode())]
            places = [(p, label) for label, phrase in license_scan.PHRASES.items() for p in range(len(own)) if own[p : p + len(phrase.split())] == phrase.encode().split()]
            assert (got[i]["n_words"], got[i]["n_base"]) == (len(own), len(places))
    assert license_scan.license_scan(H.empty(spark)).count() == 0


def test_license_phrases_by_brute_force():
    index = license_scan.LicenseIndex({w: 1.0 + len(w) for w in license_scan.template_words()})
    rng = random.Random(3)
    vocabulary = b"cc by general public license all rights reserved x".split()
    for _ in range(500):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        want = sorted((p, label) for label, phrase in license_scan.PHRASES.items() for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.encode().split())
        assert sorted(index.scan(words)[0]) == want


def test_vector_dedup(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 16))
    near = base[:20] + 0.15 * rng.normal(size=(20, 16))
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(np.concatenate([base, near, base[:3], 2 * base[:2]]))]
    usable = [(i, np.array(v)) for i, v in rows]
    rows += [(500, None), (501, [0.0] * 16), (502, [float("nan")] + [1.0] * 15), (503, [None] + [1.0] * 15), (504, [float("inf")] * 16), (505, []), (506, [1.0, 0.0]), (507, [1.0, 0.01])]
    pairs = [(i, j) for i, a in usable for j, b in usable if i != j and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95] + [(506, 507), (507, 506)]
    component = H.linked(pairs, [i for i, _ in rows])
    want = sorted((i, sum(p[0] == i for p in pairs), component[i], component[i] == i) for i, _ in rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rep", F.lit(0)).withColumn("vec", F.lit(0))
    assert sorted(map(tuple, vector_dedup.vector_dedup(df).collect())) == want
    assert vector_dedup.vector_dedup(df.where("false")).count() == 0
    null = vector_dedup.vector_dedup(spark.createDataFrame([(None, [1.0, 2.0]), (3, [1.0, 2.0]), (3, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in null} == {(None, 2, None, True), (3, 2, None, False)}


def test_vector_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 8)
    rng = np.random.default_rng(2)
    rows = [(i, (np.ones(8) + 0.02 * rng.normal(size=8)).tolist()) for i in range(60)]
    found = vector_dedup.vector_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r["n_links"], r["component_id"]) for r in found} == {(59, 0)}


def test_mixing(spark):
    rows = H.edge_rows()
    found = mixing.mix_sources(H.frame(spark), epochs=40.0).collect()
    assert {r["n_lines"] for r in found} == {"extra"}
    copies = {}
    for r in found:
        copies.setdefault((r["doc_id"], r["text"], r["source"]), []).append(r["copy_no"])
    chars = {}
    for _, text, _, source, _ in rows:
        chars[source] = chars.get(source, 0) + len(text or "")
    shares = {s: math.sqrt(c) for s, c in chars.items()}
    for i, text, _, source, _ in rows:
        if i is not None and i != 18:
            rate = 40 * shares[source] / sum(shares.values()) * sum(chars.values()) / chars[source]
            draws = max(1, math.ceil(rate / mixing.LARGEST_MEAN))
            assert len(copies.get((i, text, source), [])) == sum(_poisson(f"mix:{i}:{k}", rate / draws) for k in range(1, draws + 1))
    assert mixing.mix_sources(H.empty(spark)).count() == 0
    only = mixing.mix_sources(H.frame(spark), {"hot": 1.0}, epochs=3.0).collect()
    assert {r["source"] for r in only} == {"hot"}


def _poisson(name, mean):
    import hashlib

    u = int(hashlib.md5(name.encode()).hexdigest()[:13], 16) / 2**52
    term = reached = math.exp(-mean)
    n = 0
    while reached <= u:
        n += 1
        term *= mean / n
        reached += term
    return n


def test_mixing_reaches_its_weights(spark):
    rows = [(i, "x" * 10, "en", "a" if i % 10 else "b", 10) for i in range(5000)]
    found = mixing.mix_sources(spark.createDataFrame(rows, H.SCHEMA), {"a": 1.0, "b": 3.0}).groupBy("source").count().collect()
    counts = {r["source"]: r["count"] for r in found}
    assert abs(counts["b"] / 3750 - 1) < 0.06 and abs(counts["a"] / 1250 - 1) < 0.1


def test_suffix_array_by_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        s = [rng.randint(1, rng.choice([1, 2, 5, 300])) for _ in range(rng.randint(0, 70))]
        assert suffix_dedup.suffix_array(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def distinct_ids():
    seen, out = set(), []
    for r in H.edge_rows():
        if r[0] not in seen:
            seen.add(r[0])
            out.append(r)
    return out


@pytest.mark.parametrize("in_task", [8_000, 1])
def test_suffix_dedup(spark, monkeypatch, in_task):
    monkeypatch.setattr(suffix_dedup, "RUNS_IN_TASK", in_task)
    rows = distinct_ids()
    found = suffix_dedup.suffix_dedup(H.frame(spark, rows)).collect()
    assert sorted((H.ordered(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], H.sha(bytes(r["kept"]))) for r in found) == H.removed_bytes(rows)
    assert suffix_dedup.suffix_dedup(H.frame(spark)).count() == len(H.edge_rows())
    assert suffix_dedup.suffix_dedup(H.empty(spark)).count() == 0


def test_substring_dedup(spark):
    rows = H.edge_rows()
    found = substring_dedup.substring_dedup(H.frame(spark)).collect()
    assert sorted((H.ordered(r["doc_id"]), r["n_words"], r["n_removed"], H.sha(r["kept_text"])) for r in found) == sorted(H.removed_words(rows))
    assert substring_dedup.substring_dedup(H.empty(spark)).count() == 0


def test_bpe_round_trip(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(bpe.vocabulary_path())
    rows = H.edge_rows()
    found = bpe.bpe(H.frame(spark)).collect()
    texts = {}
    for i, text, *_ in rows:
        texts.setdefault(i, set()).add(text or "")
    assert len(found) == len(rows)
    for r in found:
        ids = list(r["ids"])
        assert any(own.encode(t, add_special_tokens=False).ids == ids for t in texts[r["doc_id"]])
        assert own.decode(ids, skip_special_tokens=False) == r["decoded"]
    assert bpe.bpe(H.empty(spark)).count() == 0


def test_bpe_encoder_by_the_library():
    from tokenizers import Tokenizer

    with open(bpe.vocabulary_path(), encoding="utf-8") as f:
        encoder = bpe.Encoder(f.read())
    cache, own, rng = bpe._Words(encoder), Tokenizer.from_file(bpe.vocabulary_path()), random.Random(1)
    texts = ["", "it's they'll <|endoftext|>x", "ΑΣ ΣΑΣ. İ Ⅷ½", "a\x00b\x1cc\x85d", "Ᲊ՘"]
    texts += ["".join(rng.choice("abehilnorst") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    texts += ["".join(rng.choice(["th", "e", "in", "é", "ß", "!!", "--", "aaa"]) for _ in range(rng.randint(1, 20))) for _ in range(3000)]
    for t in texts:
        want = own.encode(t, add_special_tokens=False).ids
        got = bpe.encode_text(encoder, cache, t)
        assert got.tolist() == want
        assert bpe.decode_ids(encoder, got).decode() == own.decode(want, skip_special_tokens=False)


def test_line_dedup(spark):
    rows = distinct_ids()
    df = H.frame(spark, rows)
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(df).collect()}
    seen, want = set(), {}
    for i, t in sorted(((H.ordered(r[0]), r[1]) for r in rows), key=lambda x: x[0]):
        lines = (t or "").split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if w in seen:
                gone.update((p, p + 1, p + 2))
            seen.add(w)
        want[i] = (None if t is None else "\n".join(x for p, x in enumerate(lines) if p not in gone), 0 if t is None else len(lines), len(gone))
    assert {H.ordered(i): (r["text"], r["n_lines"], r["n_removed"]) for i, r in got.items()} == want
    assert got[14]["text"] == "a\nb" and got[14]["n_chars"] == 3 and got[15]["text"] == "" and got[13]["score"] == "extra"
    assert line_dedup.line_dedup(H.frame(spark)).count() == len(H.edge_rows())
    assert line_dedup.line_dedup(H.empty(spark)).count() == 0


def test_quotient_filter():
    rng = np.random.default_rng(4)
    parts = [rng.integers(0, 2**64, 500, dtype=np.uint64) for _ in range(3)]
    parts[1][:50] = parts[0][:50]
    merged = exact_dedup.CountingQuotientFilter.merged([exact_dedup.CountingQuotientFilter.from_bytes(exact_dedup.CountingQuotientFilter.build(9, p).to_bytes()) for p in parts])
    values, counts = np.unique(np.concatenate(parts), return_counts=True)
    got_values, got_counts = merged.items()
    assert (got_values == values).all() and (got_counts == counts).all()


def test_fingerprints_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD", 16)
    rows = [(x * 0x9E3779B97F4A7C15 % 2**64 - 2**63,) for x in [*range(3000), *range(0, 3000, 7), 7, 7]]
    assert exact_dedup.shard_bits(len(rows)) > exact_dedup.FEWEST_BITS
    found = exact_dedup.repeated_fingerprints(spark.createDataFrame(rows, "fp long").repartition(5)).collect()
    assert sorted(r[0] for r in found) == sorted({r[0] for r in rows[3000:]})


def test_exact_dedup(spark):
    rows = H.edge_rows()
    norm = [(i, H.SPACE.sub(" ", t or "")) for i, t, *_ in rows]
    want = []
    for i, t in norm:
        ids = [j for j, u in norm if u == t]
        keep = min((j for j in ids if j is not None), default=None)
        want.append((H.ordered(i), H.ordered(keep), len(ids), i == keep, H.sha(t)))
    found = exact_dedup.exact_dedup(H.frame(spark)).collect()
    assert sorted((H.ordered(r["doc_id"]), H.ordered(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in found) == sorted(want)
    assert exact_dedup.exact_dedup(H.empty(spark)).count() == 0


def test_minhash_dedup(spark):
    rng = random.Random(8)
    base = [f"t{rng.randint(0, 4000)}" for _ in range(120)]
    rows = H.edge_rows()
    for i in range(100, 140):
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(120)] = f"n{rng.randint(0, 9)}"
        rows.append((i, " ".join(own), "en", "a", 1))
    found = minhash_dedup.minhash_dedup(H.frame(spark, rows), words=4).collect()
    got = sorted((H.ordered(r["doc_id"]), r["n_shingles"], H.ordered(r["component_id"])) for r in found)
    assert got == H.minhash_expected(rows, 4)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)
    kept = minhash_dedup.keep_one_each(H.frame(spark, rows)).select("doc_id").collect()
    assert 1 not in {r[0] for r in kept} and None in {r[0] for r in kept}  # the null id counts as smallest
    assert minhash_dedup.minhash_dedup(H.empty(spark)).count() == 0


def test_quality(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = sum((r["score"] >= 0.7) == (r["quality"] == 1) for r in rows) / len(rows)
    assert len(rows) > 50 and right > 0.93


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (4, None)], "doc_id long, quality int")
    found = quality.classify(H.frame(spark), labels).collect()
    assert len(found) == len(H.edge_rows()) and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in found)
    assert {r["held_out"] for r in found if r["doc_id"] is None} == {False}
    none = labels.where("false")
    assert {round(r["score"], 6) for r in quality.classify(H.frame(spark), none).collect()} == {0.5}
    assert quality.classify(H.empty(spark), none).count() == 0
    kept = quality.quality_filter(H.frame(spark), none, accept=0.4)
    assert kept.count() == len(H.edge_rows()) and kept.columns == H.frame(spark).columns


def test_network_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 6))
    y = (x[:, 0] - 2 * x[:, 1] + x[:, 2] > 0).astype(int)
    network = quality.train(x, y)
    assert ((network.probabilities(x) > 0.5) == y).mean() > 0.9 and 0.5 <= network.temperature <= 10


def test_minhash_common_passage(spark, monkeypatch):
    """Many texts that share one passage, beside a group of near copies with a fringe that links with nothing."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    passage, base = [word() for _ in range(60)], [word() for _ in range(150)]
    rows = [(i, " ".join(passage + [word() for _ in range(rng.randint(8, 90))]), "en", "a", 1) for i in range(2000)]
    for i in range(2000, 2300):
        own = list(base)
        for _ in range(rng.randint(1, 9)):
            own[rng.randrange(150)] = f"n{rng.randint(0, 9)}"
        rows.append((i, " ".join(own), "en", "a", 1))
    made = []
    whole = minhash_dedup.candidates
    monkeypatch.setattr(minhash_dedup, "candidates", lambda *a: made.append(whole(*a)) or made[-1])
    found = minhash_dedup.minhash_dedup(spark.createDataFrame(rows, H.SCHEMA), words=4).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, found.collect())) == H.minhash_expected(rows, 4)
    assert made


@pytest.mark.parametrize("sizes", [(3, 40), (45, 130), (200, 900)])
def test_candidates_lose_no_similar_pair(spark, sizes):
    rng = random.Random(sum(sizes))
    sets = []
    for g in range(12):
        base = [g * 10_000 + x for x in range(rng.randint(*sizes))]
        for _ in range(6):
            own = {t if rng.random() > 0.07 else rng.randint(10**6, 10**6 + 2000) for t in base[: rng.randint(int(0.75 * len(base)), len(base))]}
            sets.append(own | set(rng.sample(range(500_000, 500_050), rng.randint(0, 3))))
    tokens = spark.createDataFrame([(c, len(s), t) for c, s in enumerate(sets) for t in s], "c long, n long, token long")
    members = spark.createDataFrame([(c, c - c % 2) for c in range(len(sets))], "c long, comp long")
    got = set(map(tuple, minhash_dedup.candidates(tokens, members, 80).collect()))
    for a, one in enumerate(sets):
        for b in range(a + 1, len(sets)):
            if a // 2 != b // 2 and 100 * len(one & sets[b]) >= 80 * len(one | sets[b]):
                assert (a, b) in got


def test_components_of_a_heavy_centre(spark, monkeypatch):
    from textloom.llm import common

    monkeypatch.setattr(common, "BROADCAST_EDGES", 10)
    monkeypatch.setattr(common, "HEAVY", 30)
    monkeypatch.setattr(common, "HEAVY_SHARE", 50)
    edges = [(500, i) for i in range(200)] + [(1000 + i, 1001 + i) for i in range(50)] + [(199, 2000)]
    found = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == dict.fromkeys([*range(200), 500, 2000], 0) | dict.fromkeys(range(1000, 1051), 1000)


def test_filters_lose_no_key(spark, monkeypatch):
    """Whatever their number: those within the bound, and a set too large for a filter."""
    keys, rows = spark.range(0, 3000, 3), spark.range(3000)
    for most in (30, 12):
        monkeypatch.setattr(KeyFilter, "MOST_BITS", most)
        passed = {r[0] for r in rows.where(KeyFilter(keys, F.xxhash64("id")).may_hold()).collect()}
        assert passed >= set(range(0, 3000, 3)) and (len(passed) < 1100) == (most == 30)


def test_saturated_sketch_loses_nothing(spark, monkeypatch):
    """With far too few cells most runs pass, and the results stay."""
    from textloom.llm import sketch

    monkeypatch.setattr(sketch, "MOST_BITS", 10)
    monkeypatch.setattr(sketch, "FEWEST_BITS", 10)
    rows = distinct_ids()
    found = substring_dedup.substring_dedup(H.frame(spark, rows)).collect()
    assert sorted((H.ordered(r["doc_id"]), r["n_words"], r["n_removed"], H.sha(r["kept_text"])) for r in found) == sorted(H.removed_words(rows))
    found = suffix_dedup.suffix_dedup(H.frame(spark, rows)).collect()
    assert sorted((H.ordered(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], H.sha(bytes(r["kept"]))) for r in found) == H.removed_bytes(rows)


def test_clean_deletes_what_was_written(spark):
    import os

    written = materialize(spark.range(5), "five")
    assert written.count() == 5 and os.listdir(shared_folder(spark).removeprefix("file:"))
    clean(spark)
    assert not os.path.exists(shared_folder(spark).removeprefix("file:"))
