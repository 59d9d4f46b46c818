import random
import re

import pytest

from millrace.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def cases():
    draw = random.Random(7)
    few = "a bb ccc the & | $$ 日本 ñandú".split()
    yield from (None, "", " \t\n\x0b", "one", "a b c d e", "a b c d e a b c d e", "x " * 4000, "a\n\na\n b\n b\n", "a b c\x1cd", "\x00 \x00", "|" * 50)
    for _ in range(150):
        yield "".join(draw.choice(few) + draw.choice([" ", "  ", "\n", "\t ", "\r\n"]) for _ in range(draw.randrange(60)))


def test_counts_match_brute_force(spark):
    rows = [(i, t, "clash") for i, t in enumerate(cases())]
    judged = rules.judge(spark.createDataFrame(rows, "doc_id long, text string, quality_ string"), "text")
    got = {r.doc_id: r for r in judged.collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        q = got[i].quality
        want = brute(t)
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == want, repr(t)
        assert (set(q.failed) & {"few_words", "repeat_ratio"} != set()) == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert q.kept == (not q.failed)


PROSE = "The rain was on the hill and it fell for all of that day, with little wind from the sea at noon. {}"


@pytest.mark.parametrize(
    ("text", "kept"),
    [
        (PROSE.format("People walked."), True),
        (PROSE.format("##").replace(" ", "### "), False),
        (PROSE.format("Yes").upper().replace(" ", "!! "), False),
        ("home | about us | contact | legal | press | jobs | shop | help | map | login", False),
        ("nothing to see", False),
    ],
)
def test_verdicts(spark, text, kept):
    df = spark.createDataFrame([(1, text, 5)], "doc_id long, text string, metrics int")
    assert rules.keep_good(df).columns == df.columns
    assert (rules.keep_good(df).count() == 1) == kept


def test_empty_table_and_plan(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    judged = rules.judge(df, "text")
    assert judged.count() == 0
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert rules.judge(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "text", rules=()).first().quality.kept
