import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline
from millrace.llm import rules, secrets

sys.path.insert(0, str(Path(__file__).parent))
from test_neardup import brute as near_brute


def corpus():
    draw = random.Random(11)
    vocabulary = [f"{a}{b}{c}" for a in ("th", "er", "on", "wo") for b in ("an", "re", "ti", "le") for c in ("n", "st", "ed", "ly")]
    prose = lambda n: " ".join(draw.choice(vocabulary) if draw.random() < 0.7 else draw.choice(["the", "of", "and", "in"]) for _ in range(n))
    passage = prose(90)
    rows = [prose(draw.randrange(15, 300)) for _ in range(60)]
    rows += [rows[3], rows[3], rows[5] + " " + prose(2), rows[6].replace(" ", "### ")]
    rows += [prose(40) + " " + passage + " " + prose(30) for _ in range(5)]
    rows += [prose(30) + ' token = "' + "".join(draw.choices("0123456789abcdef", k=40)) + '" ' + prose(10) for _ in range(4)]
    rows += [None, "", "few words", prose(4000)]
    return [(i, t, "en", "src", len(t or ""), "extra") for i, t in enumerate(rows)]


def test_whole_pipeline_against_brute_force(spark, tmp_path):
    rows = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long, piece string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")

    judged = rules.judge(spark.createDataFrame(rows, schema), "text").where("quality.kept").collect()
    texts = {r.doc_id: r.text for r in judged}
    groups = near_brute([(i, t, "") for i, t in texts.items()], 5, 80)
    texts = {i: t for i, t in texts.items() if groups[i][2]}
    met = Counter(t.encode()[i : i + 400] for t in texts.values() for i in range(len(t.encode()) - 399))
    for i, t in list(texts.items()):
        raw = t.encode()
        gone = {p for k in range(len(raw) - 399) if met[raw[k : k + 400]] > 1 for p in range(k, k + 400)}
        kept = bytes(b for p, b in enumerate(raw) if p not in gone).decode("utf-8", "ignore")
        texts[i] = kept
        if gone and not kept.strip():
            del texts[i]
    for i, t in texts.items():
        for start, end, kind in reversed(secrets.base_spans(t)):
            if kind == "assign":
                t = t[:start] + "[assign removed]" + t[end:]
        texts[i] = t
    slow = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    want = {i: [*slow.encode(t, add_special_tokens=False).ids, 2] for i, t in texts.items()}

    got, full = defaultdict(list), Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).orderBy("doc_id", "piece").collect():
        got[r.doc_id] += r.ids
        full[r.sequence_id] += r.length
    assert got == want
    assert max(full.values()) <= 1024
    assert {i for i, t, *_ in rows if t and not re.search("###", t) and len(t.split()) > 10} - set(want) == {60, 61, 62}


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, extra int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes, name
        assert out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0


def test_repeated_passages_of_51_short_words_go_and_of_50_stay(spark, tmp_path):
    draw = random.Random(3)
    prose = lambda n: " ".join("".join(draw.choices("abcdefghij", k=draw.randrange(1, 6))) for _ in range(n))
    short = lambda n: " ".join("".join(draw.choices("klmnop", k=draw.randrange(1, 4))) for _ in range(n))
    passage, stays = short(51), short(50)
    assert len(passage) < 400
    texts = [f"{prose(60)} {p} {prose(70)}" for p in (passage, passage, stays, stays)] + [prose(200)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, docs, str(tmp_path)).collect()}
    assert got == {i: t.replace(passage, "") for i, t in enumerate(texts)}
