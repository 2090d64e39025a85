"""Packing, materialisation, mixing and the permutation."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_helpers import ODD, make, prose  # noqa: F401
from pyspark.sql import functions as F

from portlens.llm import op01_mixing, op04_packing, op06_materialise
from portlens.llm.common import WORD
from portlens.llm.permute import permuted
from portlens.llm.tokens import WordTokens, default_path

ROWS = [*ODD, *[(100 + n, prose(n, 5 + 37 * n % 900)) for n in range(40)], (200, prose(3, 12_000))]


def token_ids(texts: list[str | None]) -> list[list[int]]:
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(default_path()).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_words_give_the_tokenizer_s_ids():
    texts = [r[1] for r in ROWS[:30]] + ["It's IT'S we'LL don't ΑΣ İ 12 ½² <|endoftext|>x a<|b \x1c \x1f   q\u0085r ok!!", "A"]
    encoder = WordTokens(default_path(), remembered=100)
    for _ in range(2):
        assert [ids.tolist() for ids in encoder.encode(texts)] == token_ids(texts)


def test_parts_are_learned_once_and_many_at_a_time():
    """Parts stay known when the table of words is emptied, and go to the tokenizer in few texts."""
    names = [a + b for a in "bcdfg" for b in ("ab", "eci", "idy", "on", "ufe", "ym\u010b")]
    texts = [" ".join(f"{x}-{y}" for y in names) for x in names]
    encoder, sent = WordTokens(default_path(), remembered=200), []

    class Counted:
        def encode_batch_fast(self, lines: list[str], **options: bool) -> list:
            sent.append(lines)
            return parts.encode_batch_fast(lines, **options)

    parts, encoder.of_parts = encoder.of_parts, Counted()
    found = [ids.tolist() for text in texts for ids in encoder.encode([text])]
    assert found == token_ids(texts) and len(encoder.words) < len(names) ** 2
    assert sum(lines.count(encoder.spelled[10]) for batch in sent for lines in batch) == len(names) + 1
    assert sum(map(len, sent)) == 1


def test_packing_places_every_id_once(make):  # noqa: F811
    pieces = op04_packing.pack(make(ROWS)).collect()
    wanted = Counter((r[0], tuple(ids), len(ids)) for r, ids in zip(ROWS, ([*i, 2] for i in token_ids([r[1] for r in ROWS])), strict=True))
    windows = defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(bytes(p.ids), "<u4")
        assert len(ids) == p.length and zlib.crc32(bytes(p.ids)) == p.ids_crc32
        windows[p.sequence_id].append((p.offset, p.length))
    for held in windows.values():
        ends = [0, *np.cumsum([n for _, n in sorted(held)]).tolist()]
        assert [o for o, _ in sorted(held)] == ends[:-1]
        assert ends[-1] <= 4096 and ends[-1] & (ends[-1] - 1) == 0
    for key in {r[0] for r in ROWS if r[0] not in (None, 5)}:
        mine = sorted((p.start, bytes(p.ids)) for p in pieces if p.doc_id == key)
        ids = tuple(np.frombuffer(b"".join(x for _, x in mine), "<u4").tolist())
        assert wanted[(key, ids, len(ids))] == 1
    assert sum(p.length for p in pieces) == sum(n * k for (_, _, n), k in wanted.items())
    assert op04_packing.query(make([])).count() == 0


def test_the_level_rule_is_the_least_sum_of_squares():
    levels, generator = op04_packing.Levels(64), np.random.default_rng(1)
    for size in generator.integers(1, 64, 300).tolist():
        before = levels.counts.copy()

        def after(h: int) -> int:
            n = before.copy()
            n[h] -= h > 0
            n[h + size] += h + size < 64
            return int((n**2).sum())

        best = min(after(h) for h in range(64 - size + 1) if h == 0 or before[h])
        levels.place((0, 0, b"", 0), size)
        assert int((levels.counts**2).sum()) == best


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutations(size):
    found = permuted(np.arange(size), size, 9)
    assert sorted(found.tolist()) == list(range(size))
    assert size < 64 or found.tolist() != permuted(np.arange(size), size, 10).tolist()


def test_materialised_shards(make, spark, tmp_path):  # noqa: F811
    shards = op06_materialise.materialise(make(ROWS), length=64, per_shard=16)
    shards.write.parquet(str(tmp_path / "shards"))
    found = sorted(spark.read.parquet(str(tmp_path / "shards")).collect(), key=lambda r: r.shard)
    total = sum(r.n_sequences for r in found)
    assert [r.first_slot for r in found] == [16 * n for n in range(len(found))] and all(r.n_sequences == 16 for r in found[:-1])
    assert all(len(r.payload) == r.n_sequences * r.stride_bytes and zlib.crc32(bytes(r.payload)) == r.payload_crc32 for r in found)
    ids = np.frombuffer(b"".join(bytes(r.payload) for r in found), "<u2")
    wanted = Counter(i for t in token_ids([r[1] for r in ROWS]) for i in [*t, 2])
    assert Counter(ids.tolist()) - wanted == Counter({2: total * 64 - sum(wanted.values())})
    assert sum(r.n_tokens for r in found) == sum(wanted.values())
    rest = sorted((r.slot, bytes(r.ids)) for r in op06_materialise.read_from(spark, str(tmp_path / "shards"), 21).collect())
    assert [s for s, _ in rest] == list(range(21, total)) and b"".join(x for _, x in rest) == ids[21 * 64 :].tobytes()
    assert op06_materialise.query(make([])).count() == 0


def test_targets_stop_at_the_limit():
    assert op01_mixing.targets([100, 100, 100], [3, 1, 2]) == pytest.approx([200, 250 / 3, 500 / 3])
    assert op01_mixing.targets([10, 0, 1000], [3, 1, 2]) == pytest.approx([20, 0, 1495])
    assert op01_mixing.targets([], []) == []


def test_mix_meets_its_targets(make):  # noqa: F811
    rows = [(n, prose(n, 50 + n % 300), "abc"[min(n % 5, 2)] if n % 7 else None) for n in range(300)] + [(None, None, "a"), (7, "", "b"), (7, "", "b")]
    docs = make(rows)
    got = op01_mixing.query(docs).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, op01_mixing.query(docs).collect()))
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    by_target = defaultdict(int)
    for r in got:
        by_target[(r.target, r.source_size)] += r.taken
    assert all(abs(taken - target) < 0.02 * target + 64 for (target, _), taken in by_target.items())
    assert sum(t for t, _ in by_target) == pytest.approx(1.5 * sum(r.size for r in got))
    mixed = op01_mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert mixed.agg(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0] == sum(r.taken for r in got)
    assert op01_mixing.query(make([])).count() == 0 and op01_mixing.mixed(make([(1, "")])).count() == 0
