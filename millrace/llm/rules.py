"""Quality rules: a table of thresholds compiled into one Spark projection.

Every metric is a built-in expression over the words and lines of one row, so there is no shuffle, no
user function, and a row needs no more memory than a few times its own text.

A word is a run of anything but ASCII white space. Null and empty texts have no words; every metric
is then 0 and every ratio 0. Repeated rows are judged alike, each by itself. Columns of the input are
kept; the metrics come in one struct column whose name the caller picks, so that names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

#: Frequent short words of English, German, French and Spanish.
STOP_WORDS = tuple(
    "a and as at for from in is of on that the this to was with "
    "auf das dem den der die ein eine für im ist mit nicht sich und von zu "
    "avec dans de des du en est et la le les par pas pour que qui sur un une "
    "al con del el los las para por se su una y".split()
)


class Rule(NamedTuple):
    """A document passes if low <= metric <= high; an end of None is open. The rule looks only at
    documents of at least ``min_words`` words: a share of few words says nothing."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: The thresholds in use. ``repeat_ratio`` and ``few_words`` are the base rules of the query contract.
BASE = (
    Rule("few_words", "n_words", low=10),
    Rule("repeat_ratio", "repeat_ratio", high=0.20),
)
TABLE = (
    Rule("word_length", "word_length", low=1.5, high=20, min_words=10),
    Rule("symbol_ratio", "symbol_ratio", high=0.2, min_words=10),
    Rule("shout_ratio", "shout_ratio", high=0.3, min_words=10),
    Rule("capital_ratio", "capital_ratio", high=0.6, min_words=10),
    Rule("stop_ratio", "stop_ratio", low=0.01, min_words=120),
    Rule("dup_line_ratio", "dup_line_ratio", high=0.5, min_words=10),
)


def _without(text: Column, letters: str) -> Column:
    return F.translate(text, letters, "")


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def metrics(df: DataFrame, text: str, out: str = "metrics", window: int = 5, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """Add the struct ``out``: counts (long) and ratios (double) of the rules.

    ``n_repeat_words`` counts the words inside any ``window``-word window that occurs twice or more in
    the text. Windows are compared by a hash first; only where two hashes are equal are the windows
    themselves sorted and compared, so the count is exact."""
    names = [f"_{out}_{x}" for x in ("text", "words", "lines", "hashes", "windows", "starts")]
    raw, words, lines, hashes, windows, starts = names
    held = lambda i: F.get(F.col(words), i)
    df = df.withColumn(raw, F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn(words, F.array_remove(F.split(F.translate(raw, WHITE[1:], " " * (len(WHITE) - 1)), " "), ""))
    df = df.withColumn(lines, F.filter(F.split(raw, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != ""))
    last = F.size(words) - window  # the last window's start
    grid = lambda n: F.when(n >= 0, F.sequence(F.lit(0), n))
    df = df.withColumn(hashes, F.transform(grid(last), lambda i: F.xxhash64(*[held(i + k) for k in range(window)])))
    suspect = F.size(hashes) > F.size(F.array_distinct(hashes))
    df = df.withColumn(
        windows,
        F.when(
            suspect,
            F.sort_array(F.transform(grid(last), lambda i: F.struct(F.concat_ws(" ", *[held(i + k) for k in range(window)]).alias("w"), i.alias("i")))),
        ),
    )
    near = lambda k: F.get(F.col(windows), k)
    twice = lambda k: F.coalesce(near(k)["w"] == near(k - 1)["w"], F.lit(False)) | F.coalesce(near(k)["w"] == near(k + 1)["w"], F.lit(False))
    found = F.transform(F.filter(grid(F.size(windows) - 1), twice), lambda k: near(k)["i"])
    df = df.withColumn(starts, F.sort_array(found))
    covered = F.aggregate(
        grid(F.size(starts) - 1),
        F.lit(0),
        lambda total, k: total + F.least(F.lit(window), F.coalesce(F.get(F.col(starts), k + 1) - F.get(F.col(starts), k), F.lit(window))),
    )
    chars = F.length(_without(F.col(raw), WHITE))
    counts = {
        "n_words": F.size(words),
        "word_chars": chars,
        "n_symbols": F.length(raw) - F.length(_without(F.col(raw), SYMBOLS)),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_lines": F.size(lines),
        "n_shouts": F.length(raw) - F.length(_without(F.col(raw), "!")),
        "n_capitals": F.length(raw) - F.length(_without(F.col(raw), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        "n_stop_words": F.size(F.filter(F.col(words), lambda w: F.lower(w).isin(*stop_words))),
    }
    df = df.withColumn(out, F.struct(*[c.cast("long").alias(name) for name, c in counts.items()]))
    n = lambda name: F.col(out)[name]
    ratios = {
        "word_length": _ratio(n("word_chars"), n("n_words")),
        "symbol_ratio": _ratio(n("n_symbols"), n("n_words")),
        "shout_ratio": _ratio(n("n_shouts"), n("n_words")),
        "capital_ratio": _ratio(n("n_capitals"), n("word_chars")),
        "stop_ratio": _ratio(n("n_stop_words"), n("n_words")),
        "dup_line_ratio": _ratio(n("n_dup_lines"), n("n_lines")),
        "repeat_ratio": _ratio(n("n_repeat_words"), n("n_words")),
    }
    everything = F.struct(*[n(name).alias(name) for name in counts], *[c.alias(name) for name, c in ratios.items()])
    return df.withColumn(out, everything).drop(*names)


def failed(rules: Sequence[Rule], of: str = "metrics") -> Column:
    """The names of the rules that a row of metrics breaks, in the table's order."""
    broken = []
    for r in rules:
        value = F.col(of)[r.metric]
        outside = F.lit(False)
        if r.low is not None:
            outside = outside | (value < r.low)
        if r.high is not None:
            outside = outside | (value > r.high)
        broken.append(F.when(outside & (F.col(of)["n_words"] >= r.min_words), F.lit(r.name)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def judge(df: DataFrame, text: str, rules: Sequence[Rule] = (*BASE, *TABLE), out: str = "quality", **options) -> DataFrame:
    """Add ``out``: a struct of the metrics, of ``failed`` (rules broken) and of ``kept``.

    ``kept`` holds a term that is always true but not deterministic: without it Spark would push a filter
    on the verdict below the projections and write every metric out again in each place it is used."""
    metric = f"_{out}_metrics"
    judged = metrics(df, text, metric, **options).withColumn(f"{metric}_failed", failed(rules, metric))
    return judged.withColumn(
        out, F.struct(f"{metric}.*", F.col(f"{metric}_failed").alias("failed"), ((F.size(f"{metric}_failed") == 0) & (F.monotonically_increasing_id() >= 0)).alias("kept"))
    ).drop(metric, f"{metric}_failed")


def keep_good(df: DataFrame, text: str = "text", rules: Sequence[Rule] = (*BASE, *TABLE)) -> DataFrame:
    """The rows that break no rule, with the columns they came with."""
    return judge(df, text, rules, "_quality").where("_quality.kept").drop("_quality")
