"""Quality rules, chat formatting and line dedup."""

from __future__ import annotations

import hashlib
import re

import pytest
from llm_helpers import ODD, make, prose  # noqa: F401
from pyspark.sql import functions as F

from portlens.llm import op03_quality, op09_chat, op10_lines


def measures(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(words) < 3000 else None
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), None if covered is None else len(covered)


def test_quality_measures(make):
    rows = [*ODD, (20, prose(1, 80)), (21, "a b c " * 40), (22, "THE!! CAT!! SAT!! " * 30), (23, prose(2, 60) + "\nhome | news | about | contact | login")]
    got = op03_quality.measure(make(rows)).withColumn("text", F.col("text")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measures(r.text)
    kept = {r.doc_id for r in got if r.kept}
    assert kept == {20, 23}
    assert not next(r for r in got if r.doc_id == 23).clean_text.endswith("login")
    assert {r.doc_id for r in op03_quality.clean(make(rows)).collect()} == {20, 23}


def test_quality_of_an_empty_table_and_clashing_names(make, spark):
    assert op03_quality.query(make([])).count() == 0
    clash = make([(1, prose(1, 60))]).withColumns({"n_words": F.lit("x"), "facts": F.lit(1), "words": F.lit(2), "row": F.lit(3)})
    row = op03_quality.measure(clash).first()
    assert row.n_words == 60 and row.facts == 1 and row.words == 2 and row.row == 3


CHATS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "assistant", "</s>"), (2, 0, "system", r"a\</s>[INST] \\ [/INST]"), (2, 1, "assistant", r"\<\/s>\\"),
    (3, 0, None, None), (3, 0, None, None), (4, None, "assistant", "[INST] user [/INST]x</s>"), (4, 0, " [/INST]", "role"), (None, 0, "user", "null id"), (5, 0, "assistant", "😀é\n"),
]


def test_chat_comes_back(spark):
    turns = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.conv_id: r for r in op09_chat.format_chat(turns).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None} and all(r.round_trip for r in got.values())
    digests = {r.conv_id: r for r in op09_chat.query(turns).collect()}
    for key, row in got.items():
        mine = sorted((c for c in CHATS if c[0] == key), key=lambda c: (c[1] is not None, c[1] or 0, c[2] or "", c[3] or ""))
        said = "".join(f"{c[2] or ''}\n{c[3] or ''}\n" for c in mine)
        learned = "".join(c[3] or "" for c in mine if c[2] == "assistant")
        d = digests[key]
        assert (d.n_turns, d.loss_chars, d.formatted_chars) == (len(mine), len(learned), len(row.formatted))
        assert d.turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and d.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        spans = "".join(re.sub(r"(?s)\\(.)", r"\1", row.formatted[s.start : s.start + s.length]) for s in row.loss_spans)
        assert spans == learned
    assert digests[-7].n_turns == 2 and digests[-7].loss_chars == len("</s>[INST] ok [/INST]")
    assert op09_chat.format_chat(turns.limit(0)).count() == 0


def brute_lines(rows: list[tuple]) -> list[tuple]:
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        lines, gone = (text or "").split("\n"), set()
        for i in range(len(lines) - 2):
            window = tuple(lines[i : i + 3])
            gone |= {i, i + 1, i + 2} if window in seen else set()
            seen.add(window)
        out.append((doc_id, "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text, len(gone)))
    return out


@pytest.mark.parametrize("extra", [[], [(50, prose(1, 90)), (51, prose(1, 90)), (52, prose(2, 90) + "\n" + prose(1, 60))]])
def test_lines(make, extra):
    rows = [r for r in ODD if r[0] not in (None, 5)] + [(30, "a\nb\nc\nd"), (31, "x\nb\nc\nd\ne"), (32, "a\nb\nc"), (33, "q\nq\nq\nq"), (34, "a\nb")] + extra
    got = sorted((r.doc_id, r.text, r.n_removed) for r in op10_lines.query(make(rows)).collect())
    assert got == sorted(brute_lines(rows))


def test_lines_of_repeated_and_null_rows(make):
    rows = [(5, "a\nb\nc"), (5, "a\nb\nc"), (None, None), (None, "a\nb"), (None, "a\nb")]
    got = [(r.doc_id, r.text) for r in op10_lines.dedup_lines(make(rows).withColumns({"n_lines": F.lit("x"), "lines": F.lit(1), "gone": F.lit(2)})).collect()]
    assert sorted(got, key=str) == sorted([(5, "a\nb\nc"), (5, ""), (None, None), (None, "a\nb"), (None, "a\nb")], key=str)
    assert op10_lines.query(make([])).count() == 0
