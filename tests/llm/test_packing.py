import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from millrace.llm import packing

FILE = "/opt/tokenizers/byte_bpe_50k.json"


def test_ids_match_the_tokenizer_and_places_are_gapless(spark):
    draw = random.Random(4)
    words = ["the", "Größe", "don't", "  ", "\n\n", "123", "!?", "日本", "<|endoftext|>", "é", "\t", " x"]
    texts = [None, "", "a", "word " * 3000, " " * 500] + ["".join(draw.choices(words, k=draw.randrange(400))) for _ in range(120)]
    slow = Tokenizer.from_file(FILE)
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, piece int").repartition(3)
    rows = packing.pack(df, FILE, open_bins=8, with_ids=True).collect()
    docs, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
        assert 0 < r.length <= 1024 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for i, t in enumerate(texts):
        parts = sorted(docs[i], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts)))
        assert [x for r in parts for x in r.ids] == [*slow.encode(t or "", add_special_tokens=False).ids, 2]
        assert [r.start for r in parts] == [sum(x.length for x in parts[:k]) for k in range(len(parts))]
        assert all(r.length == 1024 for r in parts[1:])
    for held in bins.values():
        held.sort(key=lambda r: r.offset)
        assert [r.offset for r in held] == [sum(x.length for x in held[:k]) for k in range(len(held))]
        assert sum(r.length for r in held) <= 1024
    assert packing.pack(df.limit(0), FILE).count() == 0


def test_a_special_token_is_one_id(spark):
    df = spark.createDataFrame([(1, "a<|endoftext|>b"), (2, "<|endoftext"), (3, "<|endoftext|>" * 1023)], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in packing.pack(df, FILE, with_ids=True).collect()}
    assert got[1] == [64, 50256, 65, 2] and 50256 not in got[2] and got[3] == [50256] * 1023 + [2]


def test_pieces_at_the_edges_of_a_sequence(spark):
    df = spark.createDataFrame([(n, "a " * (n - 1) + "a") for n in (1022, 1023, 1024, 2047, 2048)], "doc_id long, text string")
    found = defaultdict(list)
    for r in packing.pack(df, FILE).orderBy("doc_id", "piece").collect():
        found[r.doc_id].append(r.length)
    assert found == {1022: [1023], 1023: [1024], 1024: [1, 1024], 2047: [1024, 1024], 2048: [1, 1024, 1024]}


class PlainPacker:
    """Best fit by looking at every open bin; of equal ones the last that came to its amount of space."""

    def __init__(self, size, open_bins):
        self.size, self.open_bins, self.next, self.bins = size, open_bins, 0, []  # bins: (free, number), latest last

    def put(self, length):
        fitting = [b for b in self.bins if b[0] >= length]
        if fitting:
            room = min(b[0] for b in fitting)
            free, number = [b for b in self.bins if b[0] == room][-1]
            self.bins.remove((free, number))
        else:
            if len(self.bins) >= self.open_bins:
                fullest = min(b[0] for b in self.bins)
                self.bins.remove([b for b in self.bins if b[0] == fullest][-1])
            free, number = self.size, self.next
            self.next += 1
        if free > length:
            self.bins.append((free - length, number))
        return number, self.size - free


def test_against_a_plain_packer():
    draw = random.Random(21)
    for size, open_bins in ((10, 1), (10, 3), (100, 7), (1024, 40)):
        fast, plain = packing.Packer(size, open_bins), PlainPacker(size, open_bins)
        for _ in range(3000):
            n = draw.randint(1, size if draw.random() < 0.3 else max(1, size // 4))
            assert fast.put(n) == plain.put(n)


def test_best_fit_and_bounded_space():
    p = packing.Packer(10, 2)
    assert [p.put(n) for n in (6, 7, 3)] == [(0, 0), (1, 0), (1, 7)]  # 3 fits bin 1 exactly
    assert p.put(8) == (2, 0) and p.put(9) == (3, 0)  # bin 2, the fullest, closes
    assert p.put(4) == (0, 6) and p.put(1) == (3, 9)
    assert p.free == 0 and p.count == 0


def test_few_sequences():
    draw = random.Random(8)
    lengths = [min(1024, int(draw.lognormvariate(5, 1)) + 1) for _ in range(5000)]
    p = packing.Packer(1024, packing.OPEN_BINS)
    used = {p.put(n)[0] for n in lengths}
    assert len(used) <= 1.02 * sum(lengths) / 1024 + 1
