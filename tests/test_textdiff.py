"""Edit scripts, their sections and places, and what is kept out of them, on known texts."""

from __future__ import annotations

import random
import re
import tracemalloc
from collections import Counter

from pyspark.sql import functions as F

from docloom.functions import editscript
from docloom.functions import textdiff as td


def span(start, end, page=0):
    return {"page": page, "start": start, "end": end}


def told(script):
    return [(s["kind"], s["text"], [(c["start"], c["end"]) for c in s["char_spans"]], s["word_spans"], s["repeated"]) for s in td.sections(script)]


def test_white_space_of_any_kind_is_one():
    assert td.edit_script(td.word_tokens("pay 9 days late\n"), td.word_tokens("pay\t9\fdays\nlate\n")) == [(td.KEPT, "pay 9 days late ")]


def test_words_lose_special_characters_if_they_have_others():
    assert td.word_tokens("X-ray, ** [b] 7%", plain=True) == ["xray ", "** ", "b ", "7%"]


def test_sections_of_words():
    script = td.edit_script(td.word_tokens("fee of 30 a month"), td.word_tokens("fee of 45 per month"))
    assert told(script) == [(td.GONE, "30 a ", [(7, 12)], [span(2, 4)], False), (td.COME, "45 per ", [(7, 14)], [span(2, 4)], False)]
    script = td.edit_script(td.word_tokens("red fox\nran off"), td.word_tokens("the red fox\noff it ran"))
    assert told(script) == [(td.COME, "the ", [(0, 4)], [span(0, 1)], False), (td.GONE, "ran off", [(8, 15)], [span(2, 4)], False), (td.COME, "off it ran", [(12, 22)], [span(3, 6)], False)]


def test_sections_cross_pages():
    script = [(td.KEPT, "cover\n"), (td.GONE, "old fees\flist"), (td.COME, "new\fnew list two\flast")]
    assert told(script) == [
        (td.GONE, "old fees\flist", [(6, 19)], [span(1, 3), span(0, 1, 1)], False),
        (td.COME, "new\fnew list two\flast", [(6, 27)], [span(1, 2), span(0, 3, 1), span(0, 1, 2)], False),
    ]


def test_equal_sections_are_one():
    script = [(td.COME, "x\n"), (td.KEPT, "a\n"), (td.COME, "x\n")]
    assert told(script) == [(td.COME, "x\n", [(0, 2), (4, 6)], [span(0, 1), span(2, 3)], True)]
    assert td.without_repeats("a\nb\n", "x\na\nx\nb\n") == ("a\nb\n", "  a\n  b\n")


def test_words_are_taken_out_of_spans():
    assert td.without_words([span(10, 20)], 0, 5) == [span(15, 20)]
    two = [span(10, 20), span(0, 15, 1)]
    assert td.without_words(two, 5, 10) == [span(10, 15), span(5, 15, 1)]
    assert td.without_words([*two, span(0, 20, 2)], 0, 30) == [span(5, 20, 2)]
    assert td.without_words([*two, span(0, 20, 2)], 0, 15) == [span(5, 15, 1), span(0, 20, 2)]
    assert td.without_words([span(10, 20)], 0, 10) == []
    none = [span(10, 20, None), span(25, 40, None)]
    assert td.without_words(none, 5, 10) == none


def test_what_moved_on_is_no_change():
    found = td.sections([(td.GONE, "blue whale song "), (td.KEPT, "of "), (td.COME, "blue whale song "), (td.GONE, "sea ")])
    assert [(s["kind"], s["text"]) for s in td.without_moves(found)] == [(td.GONE, "sea ")]
    # 40 of 41 characters in common: its words leave both sides, what stands around stays
    moved = "thirty nine letters of one whole sentence"
    found = td.sections([(td.GONE, moved), (td.KEPT, " "), (td.COME, f"now {moved[:-1]} over")])
    assert [(s["kind"], s["word_spans"]) for s in td.without_moves(found)] == [(td.GONE, [span(6, 7)]), (td.COME, [span(0, 1), span(8, 9)])]


def common_table(a, b):
    found = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            found[i][j] = found[i + 1][j + 1] + 1 if a[i] == b[j] else max(found[i + 1][j], found[i][j + 1])
    return found


def test_scripts_are_least_and_always_the_same_one():
    """Against the whole table: equal heads are kept, else a word goes if that loses nothing, else one comes."""
    rng = random.Random(11)
    for _ in range(400):
        a, b = ([rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 18))] for _ in range(2))
        table, steps, i, j = common_table(a, b), [], 0, 0
        while i < len(a) or j < len(b):
            if i < len(a) and j < len(b) and a[i] == b[j]:
                steps, i, j = [*steps, "="], i + 1, j + 1
            elif i < len(a) and (j == len(b) or table[i + 1][j] >= table[i][j + 1]):
                steps, i = [*steps, "-"], i + 1
            else:
                steps, j = [*steps, "+"], j + 1
        found, at = [], 0
        for low, high, first, last in [*editscript.changes(a, b), (len(a), len(a), 0, 0)]:
            found += ["=" * (low - at) + "-" * (high - low) + "+" * (last - first)]
            at = high
        expected = re.sub("[-+]+", lambda m: "-" * m[0].count("-") + "+" * m[0].count("+"), "".join(steps))
        assert "".join(found) == expected
        assert editscript.common_length(a, b) == table[0][0]


def test_long_unlike_texts_take_little_memory():
    rng = random.Random(12)
    a, b = ([rng.randrange(3000) for _ in range(12_000)] for _ in range(2))
    tracemalloc.start()
    script = editscript.changes(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    kept = len(a) - sum(j - i for i, j, _, _ in script)
    assert kept == editscript.common_length(a, b) and peak < 300 * len(a)


def test_common_runs_of_characters():
    rng = random.Random(13)
    for _ in range(500):
        a, b = ("".join(rng.choice("xy") for _ in range(rng.randint(0, 14))) for _ in range(2))
        b = a[: len(a) // 2] + b[:2] + a[len(a) // 2 :] if rng.random() < 0.5 else b
        longest = max((n for n in range(min(len(a), len(b)) + 1) for i in range(len(a) - n + 1) if a[i : i + n] in b), default=0)
        for share in (0.6, 0.95, 1.0):
            found = editscript.common_run(a, b, share)
            assert (found is not None) == (longest > 0 and longest >= share * min(len(a), len(b)))
            assert not found or (found[2] == longest and a[found[0] :][:longest] == b[found[1] :][:longest])


def test_noise_is_blanked():
    assert td.without_noise("Rates last revised 4/30/2017 apply") == "Rates last                   apply"
    assert td.without_noise("page 6\n\n* a\fb", digits=True) == "page  \n  a\fb"
    assert td.without_noise("fees 11/3/15") == "fees        "


def test_scripts_lead_from_one_text_to_the_other(spark):
    rng = random.Random(1)
    rows = [(i, *(" ".join(rng.choice("abcdef") for _ in range(rng.randrange(60))) for _ in range(2))) for i in range(60)] + [(100, None, "a b"), (101, "", ""), (102, None, None)]
    df = spark.createDataFrame(rows, "k long, a string, b string")
    out = df.select("k", td.word_script("a", "b").alias("s"), td.word_changes(F.col("a"), F.col("b")).alias("w"), td.changed_sections("a", "b").alias("c")).collect()
    texts = {k: (a or "", b or "") for k, a, b in rows}
    for r in out:
        a, b = texts[r.k]
        assert "".join(x.text for x in r.s if x.kind != td.COME).split() == a.split()
        assert "".join(x.text for x in r.s if x.kind != td.GONE).split() == b.split()
        change = Counter()
        for x in r.w:
            change[x.word] += x.change
        assert {w: n for w, n in change.items() if n} == {w: n for w in set((a + " " + b).split()) if (n := b.split().count(w) - a.split().count(w))}
        for s in r.c:
            for c in s.char_spans:
                assert c.end - c.start == len(s.text)
