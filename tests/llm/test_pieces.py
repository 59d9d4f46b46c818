import random
import zlib

import pytest

from millrace.llm import pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
PIECES = ["▁", "▁▁", "a", "b", "c", "▁a", "ab", "abc", "bc", "▁ab", "ca", "é"]


def small():
    scores = {p: (i + 3, -float((i * 7) % 11) - 1) for i, p in enumerate(PIECES)}
    return pieces.Vocabulary(scores, list(range(100, 356)), 0)


def every_path(text, vocab):
    """(score, ids) of all segmentations of a normalised text."""
    table = {p: (i, s) for i, p in vocab.text.items() for s in [-float((PIECES.index(p) * 7) % 11) - 1]}
    if not text:
        return [(0.0, ())]
    out = []
    for n in range(1, len(text) + 1):
        if text[:n] in table:
            i, s = table[text[:n]]
            out += [(s + rest, (i, *ids)) for rest, ids in every_path(text[n:], vocab)]
    if text[0] not in table:
        own = tuple(vocab.byte_ids[b] for b in text[0].encode())
        out += [(vocab.unknown_score + rest, (*own, *ids)) for rest, ids in every_path(text[1:], vocab)]
    return out


def test_n_best_against_all_segmentations():
    draw, vocab = random.Random(2), small()
    texts = [None, "", " ", "a", "x", "abcabc", "a\nb"] + ["".join(draw.choices("abc  éx", k=draw.randrange(9))) for _ in range(120)]
    ids, lengths, ranked = pieces.segment(texts, pieces.Units(vocab), 5)
    again = pieces.Units(vocab, most=3)
    parts = [pieces.segment([t], again, 5) for t in texts]  # the cache starts anew now and then
    assert [p[2][0] for p in parts] == ranked and [x for p in parts for x in p[0].tolist()] == ids.tolist()
    at = 0
    for text, length, ranks in zip(texts, lengths, ranked, strict=True):
        best = ids[at : at + length].tolist()
        at += length
        paths = every_path(pieces.SPACE + text.replace(" ", pieces.SPACE), vocab) if text else [(0.0, ())]
        want = sorted((s for s, _ in paths), reverse=True)[:5]
        assert [s for s, _ in ranks] == want, repr(text)
        found = [tuple(pieces.expand(best, changes)) for _, changes in ranks]
        assert len(set(found)) == len(found)
        assert all((s, f) in paths for (s, _), f in zip(ranks, found, strict=True))


def test_round_trip_and_edges(spark):
    texts = [None, "", "Hello world", "  two  blanks ", "tab\tline\nßé日本語🙂", "x" * 20000, "\x00", "a b " * 5000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, rank int")
    rows = pieces.encode(df, MODEL, n=3).withColumn("back", pieces.decode(pieces.F.col("ids"), MODEL)).collect()
    first = {r.doc_id: r for r in rows if r.rank == 1}
    assert len(first) == len(texts)
    for i, t in enumerate(texts):
        assert first[i].back == t and first[i].text_crc32 == zlib.crc32((t or "").encode())
        assert (first[i].ids is None) == (t is None)
    for r in rows:
        if r.rank > 1:
            best = first[r.doc_id]
            whole = pieces.expand(best.ids, [(c.at, c.removed, c.ids) for c in r.changes])
            assert len(whole) == r.n_ids and whole != best.ids and r.score <= best.score
            assert r.ids is None
    assert {r.rank for r in rows if r.doc_id == 2} == {1, 2, 3}
    assert pieces.encode(df.limit(0), MODEL).count() == 0


def test_vocabulary_must_split_at_blanks():
    with pytest.raises(ValueError, match="in front"):
        pieces.Vocabulary({"a▁b": (3, -1.0)}, None, 0)


def test_ties_fall_on_the_first_units(spark):
    words = {"unhappiness": 40, "unhappiness electrifying": 300}
    for text, times in words.items():
        df = spark.createDataFrame([(1, " ".join([text] * times))], "doc_id long, text string")
        rows = {r.rank: r for r in pieces.encode(df, MODEL).collect()}
        places = sorted(c["at"] for rank in (2, 3, 4) for c in rows[rank].changes)
        step = len(rows[1].ids) // times
        units = {p // step for p in places}
        assert len({round(rows[r].score, 6) for r in (2, 3, 4)}) == 1 and units == {0, 1, 2}
