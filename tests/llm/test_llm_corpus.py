"""Contamination search, tokenizer alignment and collocations against brute force."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_helpers import DOCUMENTS, ODD, make, prose  # noqa: F401
from portlens.llm import align_units, op11_decontaminate as leaks, op12_alignment as align, op13_collocations as phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_clashes(frame, *names):
    """The same rows with extra columns that are named like results and inner columns."""
    return frame.select("*", *[F.lit("extra").alias(n) for n in names])


# --- benchmark decontamination ---------------------------------------------


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contaminated(docs, items):
    """Every window of every item against every place of every document."""
    windows = defaultdict(set)
    for item, text in items:
        found = words_of(text)
        for at in range(max(1, len(found) - 9)):
            if found:
                windows[tuple(found[at : at + 10])].add("" if item is None else str(item))
    out = []
    for doc_id, text, *_ in docs:
        found, hit, names = words_of(text), set(), set()
        for window, of in windows.items():
            for at in range(len(found) - len(window) + 1):
                if tuple(found[at : at + len(window)]) == window:
                    hit |= set(range(at, at + len(window)))
                    names |= of
        out.append((doc_id, len(found), len(hit), len(names), sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


LONG = " ".join(f"Word{i}" for i in range(30))
ITEMS = [(1, LONG), (2, "one, two THREE"), (10, "one two three"), (None, "é-漢字"), (3, None), (4, " ..."), (5, "x x x x x x x x x x x x"), (5, "tail end")]
READ = [
    (1, LONG.replace(" ", "\n")), (2, "a word3 " + LONG[40:150]), (3, "x " * 40), (4, "one two. three! one two one two three"), (None, "É é 漢字"),
    (6, "word0 word1 word2"), (7, "tail"), (8, "end tail end"), (8, "end tail end"), (9, "w " * 70_000 + "one two three"), *ODD,
]


def benchmark_of(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_contamination_matches_brute_force(spark, make, monkeypatch):  # noqa: F811
    docs, items = make(READ), benchmark_of(spark, ITEMS)
    expected = contaminated(READ, ITEMS)
    assert sorted(map(tuple, leaks.query(docs, items).collect()), key=str) == expected
    clashing = with_clashes(docs, "segment", "number", "n_words", "term"), with_clashes(items, "query", "terms", "doc_id")
    assert sorted(map(tuple, leaks.query(*clashing).collect()), key=str) == expected
    # Small segments, and many blocks of queries.
    monkeypatch.setattr(leaks, "SEGMENT", 60)
    monkeypatch.setattr(leaks, "BLOCK", 7)
    assert sorted(map(tuple, leaks.query(docs, items).collect()), key=str) == expected


def test_contamination_of_empty_tables(spark, make):  # noqa: F811
    assert leaks.query(make([(1, LONG)]).limit(0), benchmark_of(spark, ITEMS)).isEmpty()
    assert not leaks.query(make([(1, LONG)]), benchmark_of(spark, [(1, None)])).first().contaminated


def test_proximity_matches_brute_force(spark, make):  # noqa: F811
    texts = [(1, "a b c a x x b c"), (2, "c b"), (3, "b x x x x x c"), (4, "a a b b c c"), (5, None)]
    found = leaks.index(make(texts))
    queries = spark.createDataFrame([("b c", ["b", "c"]), ("a b c", ["a", "b", "c"]), ("zz", ["zz"]), ("a a", ["a", "a"])], "query string, terms array<string>")
    names = found.where("term is null").select("segment", "number", "doc_id")
    got = {(r.doc_id, r.query, r.first, r.last) for r in leaks.proximity(found, queries, 3).join(names, ["segment", "number"]).select("doc_id", "query", "first", "last").collect()}
    expected = set()
    for doc_id, text in texts:
        spelled = (text or "").split()
        for terms in (["b", "c"], ["a", "b", "c"], ["a", "a"]):
            for first, word in enumerate(spelled):
                last = next((k for k in range(first, len(spelled)) if set(terms) <= set(spelled[first : k + 1])), None)
                if word in terms and last is not None and last - first < 3:
                    expected.add((doc_id, " ".join(terms), first, last))
    assert got == expected


# --- cross-tokenizer alignment ----------------------------------------------


def aligned(texts):
    """Tokens of whole texts, all links of all groups, and counts of documents for each pair."""
    tool = align_units.Aligner(*align.default_paths())
    every = []
    for text in texts:
        spaced = (" " + text).encode() if text else b""
        a = tool.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tool.b.encode(text) if text else []
        if not text or b"".join(tool.bytes_a[i] for i in a) != spaced or b"".join(tool.bytes_b[i] for i in b) != spaced:
            every.append(None)
            continue
        ends = [np.cumsum([len(t[i]) for i in ids]).tolist() for ids, t in ((a, tool.bytes_a), (b, tool.bytes_b))]
        groups, low = [], 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            groups.append([[i for i, e in zip(ids, at, strict=True) if low < e <= end] for ids, at in zip((a, b), ends, strict=True)])
            low = end
        every.append((a, b, groups, Counter((x, y) for left, right in groups for x in left for y in right)))
    counts = Counter(p for e in every if e for p in e[3])
    highest = defaultdict(int)
    for (a, _), n in counts.items():
        highest[a] = max(highest[a], n)
    out = []
    for found in every:
        if not found:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = found
        spelled = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        best = sum(n for p, n in links.items() if counts[p] == highest[p[0]])
        out.append((len(a), len(b), len(groups), sum(links.values()), best, sum(n * counts[p] for p, n in links.items()), sha256(spelled.encode()).hexdigest()))
    return out


MIXED = [
    "The quick brown fox jumps over the lazy dog.", "The quick brown fox jumps over the lazy dog.", "the the the\nthe end", "A  b\t c \n", " lead", "trail ", "don't we'll I'M 123 4567,89",
    "漢字 かな 😀😀 é à ﬁ Å", "x y z", "a▁b ▁ c", "<|endoftext|> <s> </s> <unk> [INST]", "\n\nTwo\n\n\nlines\n", "line\nline\rline", "ééééé" * 50, "y" * 3000, "\x00\x01\x1f nul", "�퟿", "aé" * 700,
]


def result(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


def test_alignment_matches_brute_force(spark, make, monkeypatch):  # noqa: F811
    texts = MIXED + [prose(s, 60) for s in range(12)] + [r[1] for r in ODD]
    rows = [(None if k % 7 == 3 else k // 2, t) for k, t in enumerate(texts)]
    expected = sorted(((r[0], *e) for r, e in zip(rows, aligned(texts), strict=True)), key=str)
    assert result(align.query(make(rows))) == expected
    assert result(align.query(with_clashes(make(rows), "chunk", "part", "n_a", "pairs", "counts"))) == expected
    assert align.query(make(rows).limit(0)).isEmpty()
    # Many chunks, merged in several rounds.
    found = align.chunks(make(rows).repartition(24), *align.default_paths())
    runs = found.where("part is not null").select("part", "chunk", "pairs", "holders")
    monkeypatch.setattr(align, "FAN", 3)
    many = found.select("chunk").distinct().count()
    assert many > 9

    def totals(frame):
        return {(r.part, p, n) for r in frame.collect() for p, n in zip(align.unpacked(r.pairs).tolist(), align.unpacked(r.holders).tolist(), strict=True)}

    rounds = totals(align.counted(runs, many))
    monkeypatch.setattr(align, "FAN", 1000)
    assert rounds == totals(align.counted(runs, many)) and len(rounds) > 500


def test_pair_counts(make):  # noqa: F811
    got = {(r.a, r.b): r.documents for r in align.pair_counts(make([(1, "the end"), (2, "the the"), (None, "the")]), *align.default_paths()).collect()}
    assert max(got.values()) == 3 and len(got) == 2


def test_runs_come_back():
    for values in ([], [0], [5, 5, 5], list(range(0, 300_000, 2)), [9, 1, 2**40, 0]):
        assert align.unpacked(align.packed(np.array(values, np.int64))).tolist() == values


# --- collocations -----------------------------------------------------------


def collocated(docs, least, per_lang=2000):
    counts = defaultdict(Counter)
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            found = [w for w in re.split(r"[ \t]+", piece) if w]
            for size in (1, 2, 3):
                for at in range(len(found) - size + 1):
                    counts[lang or "und"][tuple(found[at : at + size])] += 1
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in often.items():
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if len(p) == 2 and any(len(q) == 3 and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in often.items()):
                continue
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        n = sum(x for p, x in f.items() if len(p) == 1)
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:per_lang], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def spoken(spark, rows):
    return spark.createDataFrame([(k, t, lang, "s", 0) for k, (t, lang) in enumerate(rows)], DOCUMENTS).repartition(3)


SPOKEN = [(prose(s % 5, 80 + s), ["en", "fr", None, "und"][s % 4]) for s in range(40)] + [("A b c, a B c! a\tb  c; d a b\u000bc a b", "en")] * 9
SPOKEN += [("one two three four five six seven " * 3, "de")] * 12 + [("z " * 500, "de"), (None, "fr"), ("", None), (" .,;: \n", "en"), ("Ж É é x", "en")] + [("hot pair " + w, "hot") for w in "abcdefgh" * 30]


@pytest.mark.parametrize("least", [3, 10])
def test_collocations_match_brute_force(spark, make, monkeypatch, least):  # noqa: F811
    rows = lambda frame: sorted(tuple(r)[:8] for r in frame.collect())
    expected = collocated(SPOKEN, least)
    assert len(expected) > 15
    assert rows(phrases.collocations(spoken(spark, SPOKEN), least)) == expected
    # Nearly every word is heavy.
    monkeypatch.setattr(phrases, "SHARE", 40)
    assert rows(phrases.collocations(with_clashes(spoken(spark, SPOKEN), "w1", "n", "f", "phrase"), least)) == expected
    assert rows(phrases.collocations(spoken(spark, SPOKEN), least, 4)) == collocated(SPOKEN, least, 4)


def test_collocations_of_odd_tables(spark, make):  # noqa: F811
    assert phrases.query(make(ODD).limit(0)).isEmpty()
    assert phrases.query(make([(1, None), (None, ""), (3, "one two three")])).isEmpty()
    assert {r.phrase for r in phrases.query(make(ODD)).collect()} >= {r[2] for r in collocated([(t, "en" if i is not None else None) for i, t in ODD], 10)}


def test_words_with_one_hash_get_another_seed(spark, make, monkeypatch):  # noqa: F811
    counted = phrases.count_words
    clash = lambda docs, seed: counted(docs, seed).withColumn("hash", F.when(F.lit(seed < 2), F.lit(7)).otherwise(F.col("hash")))
    monkeypatch.setattr(phrases, "count_words", clash)
    assert phrases.dictionary(make([(1, "a b")]))[1] == 2


def test_paths(spark):
    """A fixed passage is one path; a word that varies ends it."""
    rows = [("a b c d e f g", "en")] * 10 + [("a b x", "en")] * 10
    found = {r.phrase: r.path_words for r in phrases.collocations(spoken(spark, rows)).collect()}
    assert found["a b c"] == found["c d e"] == found["e f g"] == 7 and found["a b x"] == 3
