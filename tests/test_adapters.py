"""Windowed models with stubs in place of a network."""

import sys

from pyspark import cloudpickle

from textveil.operators import adapters, tokenize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOCAB = {t: i for i, t in enumerate([tokenize.PAD, tokenize.UNK, tokenize.CLS, tokenize.SEP, tokenize.MASK, *"人名组织机构张伟在和ABCDEFGHIJKLMNOPQRSTUVWXYZ".lower()])}


def likely(encodings):
    """Says that 张 starts and 伟 ends a person when asked for one."""
    ask = VOCAB["人"]
    start = [[0.9 if x == VOCAB["张"] and e["input_ids"][1] == ask else 0.0 for x in e["input_ids"]] for e in encodings]
    end = [[0.8 if x == VOCAB["伟"] and e["input_ids"][1] == ask else 0.0 for x in e["input_ids"]] for e in encodings]
    return start, end


def test_prompted_windows(spark):
    text = "abcdefgh张伟在" * 6
    df = spark.createDataFrame([(1, text), (2, "abc"), (3, None), (4, "")], "id long, text string")
    got = {r["id"]: [(e["category"], e["start"], e["end"], e["text"], round(e["confidence"], 6)) for e in r["entities"]] for r in adapters.prompted(df, ["id"], VOCAB, likely, "stub", max_length=25, overlap=6).collect()}
    assert got[1] == [("PERSON", i * 11 + 8, i * 11 + 10, "张伟", 0.72) for i in range(6)]
    assert got[2] == got[3] == got[4] == []


def cluener(texts):
    return [[("B-name", i, i + 2, 0.5 + i / 100) for i in range(len(t)) if t.startswith("韩静", i)] + [("I-company", i, i + 4, 0.9) for i in range(len(t)) if t.startswith("某某公司", i)] + [("book", 0, 1, 1.0)] for t in texts]


def test_token_windows(spark):
    rows = [(1, "甲" * 520 + "韩静" + "乙" * 10), (2, "甲" * 508 + "某某公司" + "乙" * 80), (3, ""), (4, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    out = adapters.token_windowed(df, ["id"], lambda t: [(i, i + 1) for i in range(len(t))], cluener, "stub")
    got = {r["id"]: [(e["category"], e["start"], e["end"], e["text"]) for e in r["entities"]] for r in out.collect()}
    assert got == {1: [("PERSON", 520, 522, "韩静")], 2: [("ORG", 508, 512, "某某公司")], 3: [], 4: []}
