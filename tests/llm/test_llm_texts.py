"""Fingerprints, the Jaccard join, toxicity, language-model scores and the pipeline."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_helpers import ODD, make, prose  # noqa: F401

from portlens.llm import op02_toxicity, op05_lm_score, op07_fingerprint, op08_jaccard
from portlens.llm.components import components


def shingles(text: str | None) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or (frozenset([tuple(words)]) if words else frozenset())


def edited(text: str, every: int) -> str:
    words = text.split(" ")
    return " ".join("zz" if n % every == every - 1 else w for n, w in enumerate(words))


def brute_components(rows: list[tuple]) -> dict:
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def top(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), top(i)) for i, s in sets}


@pytest.fixture(scope="module")
def families() -> list[tuple]:
    """Exact copies, near copies at many distances, a shared passage, and odd texts."""
    rows = [r for r in ODD if r[0] not in (None, 5)]
    passage = prose(99, 60)
    for n in range(25):
        text = prose(n, 40 + 11 * n)
        rows += [(100 * n + 100 + k, t) for k, t in enumerate([text, text.upper(), edited(text, 30), edited(text, 45), edited(text, 17), text + " " + passage, passage + " " + edited(text, 60)])]
    base = prose(7, 200)
    return rows + [(10_000 + n, edited(base, 40 + n)) for n in range(120)]


def test_jaccard_join_is_exact(make, families, monkeypatch):  # noqa: F811
    # Small tiles send the larger groups through every step.
    for name, value in (("TILE", 8), ("MEMBERS", 16), ("HEAVY", 3)):
        monkeypatch.setattr(op08_jaccard, name, value)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op08_jaccard.query(make(families)).collect()}
    assert got == brute_components(families)


def test_jaccard_join_of_repeated_and_null_rows(make):  # noqa: F811
    text = prose(1, 50)
    rows = [(3, text), (3, text), (2, text + " end"), (None, text), (None, None), (9, "a b"), (8, "A\tB")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in op08_jaccard.query(make(rows)).collect() if r.doc_id is not None)
    assert got == [(2, 47, 2), (3, 46, 2), (3, 46, 2), (8, 1, 8), (9, 1, 8)]
    kept = op08_jaccard.keep_one(make(rows)).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["2", "8", "None"]
    assert op08_jaccard.query(make([])).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(n, n + 1) for n in range(100, 300)] + [(7, 3), (3, 7), (5, 5)], "a long, b long")
    assert {r.node: r.component for r in components(links).collect()} == {n: 100 for n in range(100, 301)} | {3: 3, 7: 3}


def test_fingerprints(make):  # noqa: F811
    rows = sorted([r for r in ODD if r[0] not in (None, 5)] + [(50 + n, prose(n // 2, 400 + n // 2)) for n in range(40)])
    got = {r.doc_id: r for r in op07_fingerprint.query(make(rows)).collect()}
    assert len(got) == len(rows)
    errors = []
    for (i, text), (j, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        text, after = text or "", after or ""
        changed = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        a, b = shingles(text), shingles(changed)
        if len(a) > 100 and a | b:
            errors.append(got[i].near_edited - len(a & b) / len(a | b))
        if text == after:
            assert got[i].near_next == 1 and got[i].fingerprint == got[j].fingerprint
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06
    assert op07_fingerprint.query(make([])).count() == 0


def brute_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """Take the best segment, then the same to its left and right."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            total = sum(scores[i:j])
            if total > 1e-9 and (best is None or total > best[2] + 1e-9):
                best = (i, j, total)
    if best is None:
        return []
    i, j, total = best
    return brute_segments(scores[:i]) + [best] + [(a + j, b + j, s) for a, b, s in brute_segments(scores[j:])]


def test_all_maximal_segments():
    generator = np.random.default_rng(3)
    for _ in range(60):
        scores = np.round(generator.normal(0, 2, 14), 3)
        got = [(a, b, round(s, 6)) for a, b, s in op02_toxicity.segments(scores, 0.1)]
        assert got == [(a, b, round(s, 6)) for a, b, s in brute_segments((scores - 0.1).tolist())]


def test_toxic_documents_are_found(make, spark):  # noqa: F811
    bad = ["grumbo", "vexlor", "snarkel"]
    rows = [(n, prose(n, 120) + (f" {bad[n % 3]} {bad[(n + 1) % 3]}s {prose(n + 5000, 9)} {bad[(n + 2) % 3]}" if n % 6 == 0 else "")) for n in range(400)]
    labels = spark.createDataFrame([(n, 1, int(n % 6 == 0)) for n in range(400)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = op02_toxicity.query(make(rows + [(1000, None), (1001, ""), (None, "x")]), labels).collect()
    assert len(got) == 403 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum(r.predicted == int(r.doc_id % 6 == 0) for r in held) >= 0.97 * len(held)
    assert op02_toxicity.query(make([]), labels).count() == 0
    assert op02_toxicity.query(make(rows[:5]), labels.limit(0)).count() == 5


def test_language_model_scores(make):  # noqa: F811
    rows = [r for r in ODD if r[0] not in (None, 5)] + [(50 + n, prose(n % 60, 100 + n % 7)) for n in range(300)]
    got = {r.doc_id: r for r in op05_lm_score.query(make(rows)).collect()}
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in rows}
    counts = Counter(t for i, ts in tokens.items() if zlib.crc32(str(i).encode()) % 10 for t in ts)
    total, distinct = sum(counts.values()), len(counts)
    for i, ts in tokens.items():
        base = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in ts)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ts), sum(counts[t] > 0 for t in ts), total)
        assert r.base_score == pytest.approx(base, abs=1e-6) and r.score < 0
    assert op05_lm_score.query(make([])).count() == 0


def test_the_model_beats_single_words_on_held_out_documents(spark):
    from portlens.llm.common import table

    held = op05_lm_score.query(table(spark, "/root/testdata/sf0.01", "documents")).where("held_out").collect()
    assert len(held) > 50
    assert sum(r.score for r in held) > 0.985 * sum(r.base_score for r in held)
    assert all(0.5 < r.bits_per_byte < 8 for r in held)


def test_word_order_counts_in_the_model(make):  # noqa: F811
    """Words in the order of training are likelier than the same words the other way round."""
    held = [n for n in range(1000) if zlib.crc32(str(n).encode()) % 10 == 0][:2]
    cycle = ["amber", "birch", "cedar", "delta", "ember"]
    rows = [(n, " ".join(cycle * 6)) for n in range(200) if zlib.crc32(str(n).encode()) % 10]
    got = {r.doc_id: r for r in op05_lm_score.query(make([*rows, (held[0], " ".join(cycle * 6)), (held[1], " ".join(cycle[::-1] * 6))])).collect()}
    told, turned = got[held[0]], got[held[1]]
    assert told.held_out and turned.held_out and told.base_score == pytest.approx(turned.base_score)
    assert told.score > turned.score + 1


def test_pipeline_against_its_parts(spark):
    import corpus_pipeline
    from portlens.llm.common import table

    folder = "/root/testdata/sf0.001"
    docs = table(spark, folder, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, folder).cache()
        assert docs.columns == before.columns and docs.count() > 0
        if name == "near_duplicates":
            wanted = brute_components([(r.doc_id, r.text) for r in before.collect()])
            assert sorted(r.doc_id for r in docs.collect()) == sorted(i for i, (_, c) in wanted.items() if i == c)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    from test_llm_tokens import token_ids

    assert pieces.groupBy().sum("length").first()[0] == sum(len(t) + 1 for t in token_ids([r.text for r in docs.collect()]))


def test_only_equal_texts_of_one_label_count_once(make):  # noqa: F811
    # The five documents share their least shingle hash or have the same words; two are copies.
    near = [prose(4, 60) + " " + word for word in ("one", "two", "three")]
    rows = [(1, near[0]), (2, near[0]), (3, near[0]), (4, near[1]), (5, near[2]), (6, None), (7, "")]
    training = make(rows).selectExpr("doc_id", "text", "cast(doc_id = 3 as int) as toxic")
    kept = sorted((r.text or "", r.toxic) for r in op02_toxicity.one_of_copies(training).collect())
    assert kept == sorted([(near[0], 0), (near[0], 1), (near[1], 0), (near[2], 0), ("", 0)])
    counts = {r.word: (r.toxic, r.clean) for r in op02_toxicity.word_counts(op02_toxicity.one_of_copies(training)).collect()}
    assert counts["one"] == (1, 1) and counts["two"] == (0, 1) and counts["three"] == (0, 1)


def test_a_table_of_any_size_gives_the_same_toxicity_scores(make, spark, monkeypatch):  # noqa: F811
    bad = ["grumbo", "vexlor", "snarkel"]
    rows = [(n, prose(n, 60) + (f" {bad[n % 3]} {bad[(n + 1) % 3]}s (Grumbo)" if n % 6 == 0 else "")) for n in range(200)] + [(1000, None), (1001, ""), (1002, "-- ?")]
    labels = spark.createDataFrame([(n, 1, int(n % 6 == 0)) for n in range(200)], "doc_id long, quality int, toxic int")

    def found() -> dict:
        return {r.doc_id: (r.n_tokens, [(s.first, s.last, round(s.score, 9)) for s in r.segments], round(r.score, 9)) for r in op02_toxicity.score(make(rows), labels).collect()}

    whole = found()
    assert any(segments for _, segments, _ in whole.values())
    # More significant entries than a table for every task may have, and several chunks for a task.
    monkeypatch.setattr(op02_toxicity, "MAX_FEATURES", 0)
    monkeypatch.setattr(op02_toxicity, "CHUNK_WORDS", 50, raising=False)
    assert found() == whole


def test_the_mixer_learns_from_every_position():
    from portlens.llm import mixing_model as model

    words, code = [b"a", b"bc", b"d", b"efghi"], model.prefix_code(np.zeros(256, np.int64))
    positions, counts, mixer = model.Positions(words, np.zeros(4, np.int64), code), np.array([5, 1, 3, 2]), model.Mixer()
    entries = positions.entries(3)
    found = model.bit_counts(entries.keys, entries.bytes, entries.weights(positions, counts), code)
    before = mixer.refined.sum()
    model.learn(mixer, positions, entries, found, counts, np.zeros_like(mixer.weights), len(words))
    # Weights of all positions sum to one; each has eight bits under this code.
    assert set(code[1].tolist()) == {8}
    assert mixer.refined.sum() - before == pytest.approx(8 * len(words))


def test_no_context_shares_its_counts(spark):
    from portlens.llm import mixing_model as model

    generator = np.random.default_rng(1)
    words = sorted({bytes(generator.integers(97, 123, 10, dtype=np.uint8)) for _ in range(20_000)})
    code = model.prefix_code(np.bincount(np.frombuffer(b"".join(words), np.uint8), minlength=256))
    positions, counts = model.Positions(words, np.zeros(len(words), np.int64), code), np.arange(len(words)) % 4
    entries = positions.entries(5)
    found = np.zeros((int(entries.lengths.sum()), 2), np.int64)
    weights, bits = entries.weights(positions, counts), entries.starts[:, None] + np.arange(int(code[1].max()))
    for shard in range(5):
        own = entries.shard == shard
        rows = bits[own][np.arange(bits.shape[1]) < entries.lengths[own][:, None]]
        found[rows] = model.bit_counts(entries.keys[own], entries.bytes[own], weights[own], code)
    # The whole word so far: every prefix and the bits after it, counted by hand.
    wanted: Counter = Counter()
    spelled = [[(w[:n], format(int(code[0][b]), f"0{int(code[1][b])}b")) for n, b in enumerate(w + b"\x01")] for w in words]
    for word, n in zip(spelled, counts.tolist(), strict=True):
        for prefix, said in word:
            for d in range(len(said)):
                wanted[prefix, said[: d + 1]] += n
    at = entries.at[4]
    for place, (prefix, said) in enumerate(x for word in spelled for x in word):
        for d in range(len(said)):
            got = found[entries.starts[at[place]] + d].tolist()
            assert got == [wanted[prefix, said[:d] + bit] for bit in "01"]


def test_classes_and_byte_code_come_from_all_training_documents(make):  # noqa: F811
    # One script in a single document of many: it gets a centre of its own and its bytes are in the code.
    chosen = next(i for i in range(5000, 6000) if zlib.crc32(str(i).encode()) % 10)
    rows = [(n, "aaaa bbbb cccc" if n % 2 else "dddd eeee") for n in range(5000)] + [(chosen, "漢" * 4000)]
    found, code = op05_lm_score.fit_classes(make(rows))
    profile = op05_lm_score.byte_profile(["漢"])
    assert ((found - profile) ** 2).sum(axis=1).min() < 1e-9 and len(found) == 3
    wanted: Counter = Counter()
    for i, text in rows:
        if zlib.crc32(str(i).encode()) % 10:
            wanted.update(b"".join(w + b"\x01" for w in text.encode().split()))
    assert code[1].tolist() == op05_lm_score.model.prefix_code(np.array([wanted[b] for b in range(256)]))[1].tolist()


def test_pairs_of_one_word_share_its_contexts():
    """What does not depend on the word before is there once for each word and class; scores are those of a count by hand."""
    from portlens.llm import mixing_model as model

    code = model.prefix_code(np.bincount(np.frombuffer(b"abc" * 9 + b"abcd", np.uint8), minlength=256))
    words, classes = [b"ab", b"ab", b"ab", b"abcd", b"b"], np.array([0, 0, 1, 0, 0])
    before, counts = np.array([7, 8, 7, 7, 0], np.uint64), np.array([3, 1, 2, 0, 4])
    positions = model.Positions(words, classes, code, before)
    bytes_of = {n: 3 + 3 + 5 + 2 if n != model.FOLLOWS else 3 * 3 + 5 + 2 for n in range(model.ORDERS)}
    assert {n: len(c) for n, c in enumerate(positions.contexts)} == bytes_of
    entries = positions.entries(2)
    found = np.zeros((int(entries.lengths.sum()), 2), np.int64)
    for shard in range(2):
        own = np.flatnonzero(entries.shard == shard)
        bits = np.concatenate([np.arange(a, a + n) for a, n in zip(entries.starts[own], entries.lengths[own], strict=True)])
        found[bits] = model.bit_counts(entries.keys[own], entries.bytes[own], entries.weights(positions, counts)[own], code)

    def context(n: int, i: int, p: int) -> tuple:
        text = bytes(32) + words[i]
        size = (2, 3, 4, 6, 32, 32, 3, 32)[n]
        return (n, text[32 + p - size : 32 + p], before[i] if n == model.FOLLOWS else None, classes[i] if n > model.FOLLOWS else None)

    spelled = [[(p, format(int(code[0][b]), f"0{int(code[1][b])}b")) for p, b in enumerate(w + b"\x01")] for w in words]
    seen: Counter = Counter()
    for i, word in enumerate(spelled):
        for p, said in word:
            for d in range(len(said)):
                for n in range(model.ORDERS):
                    seen[context(n, i, p), said[: d + 1]] += int(counts[i])
    mixer = model.Mixer(np.random.default_rng(5).normal(0.15, 0.05, (model.BUCKETS, model.ORDERS, model.BUCKETS)))
    wanted = []
    for i, word in enumerate(spelled):
        total = 0.0
        for p, said in word:
            for d in range(len(said)):
                each = [model._inputs(*(np.array([seen[context(n, i, p), said[:d] + bit]]) for bit in "01")) for n in range(model.ORDERS)]
                one = mixer.refine(*mixer.mix([x for x, _ in each], [b for _, b in each]))[0]
                total += math.log10(one if said[d] == "1" else 1 - one)
        wanted.append(total)
    assert model.score(mixer, positions, entries, found) == pytest.approx(wanted, rel=1e-9)


def test_ways_have_the_counts_of_all_that_follows_a_word():
    from portlens.llm import mixing_model as model
    from portlens.llm.followers import by_bits, followed, from_bytes, to_bytes, ways

    numbers = np.array([0, 1, 127, 128, 16_383, 16_384, 2**40, 2**62])
    assert from_bytes(to_bytes(numbers)[0]).tolist() == numbers.tolist()
    generator = np.random.default_rng(2)
    words = sorted({bytes(generator.integers(97, 100, k % 5 + 1, dtype=np.uint8)) for k in range(200)} | {b"q" * 31, b"q" * 32, b"q" * 70, b"a\x01", b"a\x01b"})
    code = model.prefix_code(np.bincount(np.frombuffer(b"aaab\x01", np.uint8), minlength=256))
    order, table, bits = by_bits(words, code)
    words = [words[i] for i in order]
    group, word = (x.reshape(-1) for x in np.meshgrid(np.arange(5), np.arange(len(words)), indexing="ij"))
    kept = generator.random(len(word)) < 0.6
    group, word, n = group[kept], word[kept], generator.integers(0, 4, int(kept.sum()))
    spelled = ["".join(format(int(code[0][b]), f"0{int(code[1][b])}b") for b in (w.partition(b"\x01")[0] + b"\x01")[:32]) for w in words]
    assert bits.tolist() == [*map(len, spelled)]
    seen: Counter = Counter()
    for g, w, k in zip(group.tolist(), word.tolist(), n.tolist(), strict=True):
        for d in range(len(spelled[w]) + 1):
            seen[g, spelled[w][:d]] += k
    start = np.minimum(3, bits)[word] * (group == 2)
    data, sizes = ways(group, word, n, start, table, bits)
    counts, after = followed(data)
    at = 0
    for g, w, a, own in zip(group.tolist(), word.tolist(), start.tolist(), np.split(data, np.cumsum(sizes)[:-1]), strict=True):
        told = followed(own)[0].tolist()
        assert told == [seen[g, spelled[w][:d]] for d in range(a, len(spelled[w]) + 1)]
        assert counts[at : at + len(told)].tolist() == told and after[at : at + len(told) - 1].tolist() == told[1:]
        at += len(told)


def test_chunks_parts_and_frequent_words_change_no_score(make, monkeypatch):  # noqa: F811
    long = ["http://example.org/a/long/path/of/things/" + str(k) for k in range(4)] + ["q" * 33, "q" * 70, "ab" * 40, "a", "a\x01", "a\x01b", "\x01"]
    rows = [*ODD, *((100 + n, prose(n % 30, 60 + n % 7)) for n in range(90)), *((300 + n, " ".join(long[(n * k) % 11] for k in range(40)) + " the x the") for n in range(40))]

    def found() -> list:
        return sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in op05_lm_score.query(make(rows)).collect())

    whole = found()
    # Many parts and chunks; the words after most words are dealt by their first bytes.
    for name, value in (("PART_WORDS", 300), ("CHUNK_WORDS", 500), ("FREQUENT", 3), ("SHARE", 10**9), ("SLICE", 7)):
        monkeypatch.setattr(op05_lm_score, name, value)
    _, _, often = op05_lm_score.surveyed(make(rows))
    assert {b"a", b"x", b"the", b"q" * 70} < set(often)
    assert found() == whole
