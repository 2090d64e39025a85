"""Mixing of small sources, the toxic scan's time, the chat loss mask, and which of tied rows stays."""

from __future__ import annotations

import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_helpers import DOCUMENTS, ODD, make, prose  # noqa: F401
from test_llm_texts import brute_components, edited
from portlens.llm import op01_mixing as mixing, op02_toxicity as toxic, op08_jaccard as jaccard, op09_chat as chat, op10_lines as lines
from portlens.llm.permute import permuted


def mix_rows() -> list[tuple]:
    """Sources of 1 to 700 words, one of them without a name, and odd texts."""
    rows = [(n, prose(n, size), name) for n, (size, name) in enumerate([(60, "a"), (60, "b"), (60, "c"), (133, "d"), (1, "e"), (700, "f"), (65, None), (64, "h")])]
    return rows + [(100 + n, r[1], "odd") for n, r in enumerate(ODD) if r[1] is None or len(r[1]) < 5000] + [(77, "again and again", "f")] * 2


def test_small_sources_meet_their_targets(make):  # noqa: F811
    names = {r[0]: r[2] for r in mix_rows()}
    taken, target = defaultdict(int), {}
    for r in mixing.query(make(mix_rows())).collect():
        assert r.taken <= 2 * r.size
        taken[names[r.doc_id]] += r.taken
        target[names[r.doc_id]] = r.target
    assert len(target) > 8 and all(abs(taken[name] - target[name]) <= 0.5 for name in target)


def test_mix_matches_a_plain_reading(make, spark):  # noqa: F811
    """Every slot read one by one: its block by the permutation, its words from the documents in their order."""
    docs = make(mix_rows())
    documents, sources = mixing.placed(docs.select("doc_id", "text", "source"))
    placed = documents.select("_source", "_position", "_size").collect()
    owner = defaultdict(dict)
    for r in placed:
        for word in range(r["_position"], r["_position"] + r["_size"]):
            assert word not in owner[r["_source"]]
            owner[r["_source"]][word] = r["_position"]
    taken: dict = defaultdict(int)
    for source, (slots, blocks, size) in enumerate(zip(sources.slots, sources.blocks, sources.sizes, strict=True)):
        assert sorted(owner[source]) == list(range(size))
        for k in range(slots):
            turn, index = divmod(k, blocks)
            block = int(permuted(np.array([index]), blocks, (source + 1) * 131_071 + turn * 8_191 + mixing.SEED)[0])
            end = min(size, block * 64 + (sources.cuts[source] if k == slots - 1 else 64))
            for word in range(block * 64, end):
                taken[source, owner[source][word]] += 1
    found = mixing.taken(documents, sources).groupBy("_source", "_position").agg(F.sum(F.col("last") - F.col("first")).alias("n")).collect()
    assert {(r["_source"], r["_position"]): r["n"] for r in found} == dict(taken)


@pytest.mark.parametrize("few", [0, 5])
def test_jaccard_join_is_exact_whatever_tiles_list(make, monkeypatch, few):  # noqa: F811
    """Pairs of small tiles are listed, larger tiles are compared by signature: the same links."""
    rows = [(n, edited(prose(n % 4, 150), 12 + n)) for n in range(60)] + [(100 + n, prose(50, 40) + " " + prose(60 + n, 130)) for n in range(25)]
    for name, value in (("TILE", 8), ("MEMBERS", 16), ("FEW", few)):
        monkeypatch.setattr(jaccard, name, value)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.query(make(rows)).collect()}
    assert got == brute_components(rows)


def quadratic_segments(scores: np.ndarray, drift: float) -> list[tuple[int, int]]:
    """Maximal scoring segments by their definition, recursively: the best stretch, then left and right of it."""
    def inside(low: int, high: int) -> list[tuple[int, int]]:
        best = max(((total[b] - total[a], -(b - a), a, b) for a in range(low, high) for b in range(a + 1, high + 1)), default=(0, 0, 0, 0))
        if best[0] <= 1e-12:
            return []
        return [*inside(low, best[2]), (best[2], best[3]), *inside(best[3], high)]

    total = np.concatenate([[0.0], np.cumsum(scores - drift)])
    return inside(0, len(scores))


def test_segments_of_longer_texts():
    generator = np.random.default_rng(3)
    for _ in range(40):
        scores = generator.normal(0, 1, 45)
        assert [s[:2] for s in toxic.segments(scores, 0.1)] == quadratic_segments(scores, 0.1)


@pytest.mark.parametrize("kind", ["sparse", "falling"])
def test_segments_take_linear_time(kind):
    """Four times the tokens take under six times as long, for one positive token in ten and for ever smaller sums."""
    def took(n: int) -> float:
        generator = np.random.default_rng(1)
        scores = np.where(generator.random(n) < 0.1, 2.0, -1.0) if kind == "sparse" else np.tile([1.0, -1.5], n // 2)
        best = float("inf")
        for _ in range(3):
            start = time.perf_counter()
            toxic.segments(scores, 0.0)
            best = min(best, time.perf_counter() - start)
        return best

    took(1000)
    assert took(160_000) < 6 * took(40_000)


def test_loss_follows_the_mask(spark):
    turns = [(1, 0, "user", "hi </s>"), (1, 1, "assistant", "yes \\ </s> [INST]"), (1, 2, "user", "é" * 1500), (1, 3, "assistant", "😀" * 2100 + "\\n"), (2, 0, "user", "x"), (3, 0, "assistant", "")]
    chats = chat.format_chat(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.digest(chats).collect()}
    said = "yes \\ </s> [INST]" + "😀" * 2100 + "\\n"
    assert got[1].loss_chars == len(said) and got[2].loss_chars == got[3].loss_chars == 0
    # Another mask gives another loss.
    none = chat.digest(chats.withColumn("loss_spans", F.slice("loss_spans", 1, 0))).collect()
    assert all(r.loss_chars == 0 for r in none)
    first = {r.conv_id: r.loss_chars for r in chat.digest(chats.withColumn("loss_spans", F.slice("loss_spans", 1, 1))).collect()}
    assert first[1] == len("yes \\ </s> [INST]")


def test_a_long_conversation_takes_linear_time(spark):
    turns = spark.range(6000).selectExpr("1L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "repeat('word ', 60) AS text")
    start = time.perf_counter()
    assert chat.query(turns).where("conv_id = 1").first().loss_chars == 3000 * 300
    assert time.perf_counter() - start < 60


def test_which_of_tied_rows_stays_does_not_change(spark):
    text = prose(3, 40)
    rows = [(1, text, lang, source, n) for lang, source, n in [("fr", "s", 1), ("en", "t", 2), ("en", "s", 3), (None, "s", 4)]]
    wanted = None
    for parts in (1, 3, 4):
        docs = spark.createDataFrame(rows[parts % 4 :] + rows[: parts % 4], DOCUMENTS).repartition(parts)
        one = jaccard.keep_one(docs).collect()
        kept = [r for r in lines.dedup_lines(docs).collect() if r.n_removed == 0]
        found = sorted(map(str, one)), sorted(map(str, kept))
        assert len(one) == len(kept) == 1 and found == (wanted or found)
        wanted = found


def test_hot_windows(make, monkeypatch):  # noqa: F811
    """Windows that go to every task and those that meet by hash give the same lines."""
    rows = [(n, f"x{n}\nsame\nthree\nlines\ny{n % 3}\nz") for n in range(30)] + [(100 + n, f"a{n // 2}\nb\nc") for n in range(6)]
    some = sorted((r.doc_id, r.text) for r in lines.query(make(rows)).collect())
    monkeypatch.setattr(lines, "HOT", 2)
    assert sorted((r.doc_id, r.text) for r in lines.query(make(rows)).collect()) == some
    assert sum("same" in text for _, text in some) == 1
