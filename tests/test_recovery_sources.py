"""Mappings' life, sinks, sources, recognisers and plans."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from textveil.operators import masking, recognise, recovery, tokenize
from textveil.operators.detect import detect
from textveil.sources import io


def at(s):
    return dt.datetime(2024, 1, 1, 0, 0, s)


@pytest.mark.parametrize("asked,live", [(4, None), (5, 1), (14, 1), (15, None), (20, 2), (26, None)])
def test_mapping_lives_from_its_making_until_it_expires(spark, asked, live):
    makes = spark.createDataFrame([("s", at(5), 1, "m"), ("s", at(16), 2, "m"), ("s", at(25), 3, None)], "session string, ts timestamp, seq long, payload string")
    asks = spark.createDataFrame([("s", at(asked), 9)], "session string, ts timestamp, seq long")
    assert recovery.live_mapping(asks, makes, "session", "ts", "seq", "payload", ttl=10).first()["mapping_id"] == live


def test_mapping_is_written_only_after_the_texts(spark, tmp_path):
    masked = masking.mask(detect(spark.createDataFrame([(1, "a@b.com"), (2, "x")], "id long, text string")))
    rows = recovery.mapping_rows(masked, ["id"])
    assert io.write_masked(masked, rows, f"{tmp_path}/t", f"{tmp_path}/m", ["id"])
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/m").collect()] == [(1, "<EMAIL_1>", "a@b.com")]


def test_settings_files(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.json").write_text(json.dumps({"hotkey": "k"}))
    (tmp_path / "s" / "b.json").write_text("broken")
    got = {r["path"].rsplit("/", 1)[1]: r for r in io.set_aside(io.read_settings(spark, f"{tmp_path}/s"), f"{tmp_path}/q").collect()}
    assert got["a.json"]["hotkey"] == "k" and not got["a.json"]["corrupt"]
    assert got["b.json"]["corrupt"] and got["b.json"]["startup"] is False
    assert [r["raw"] for r in spark.read.parquet(f"{tmp_path}/q").collect()] == ["broken"]


def test_cases_and_listing(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "cases.json").write_text(json.dumps([{"id": "a", "text": "t", "expected": {"IP": ["1"]}}, {"id": "b", "text": "u"}]))
    assert {r["id"]: r["expected"] for r in io.read_cases(spark, f"{tmp_path}/c/cases.json").collect()} == {"a": {"IP": ["1"]}, "b": None}
    assert [r["path"] for r in io.list_files(spark, f"{tmp_path}/c").collect()] == ["cases.json"]


def test_guard(spark):
    df = spark.createDataFrame([("ok",), ("",), ("  　\n",), (None,), ("x" * 11,)], "text string")
    fine, long = io.guard(df, most=10)
    assert [r["text"] for r in fine.collect()] == ["ok"] and [r["text"] for r in long.collect()] == ["x" * 11]


def test_recogniser_loads_once_and_degrades(spark):
    def loader():
        class Model:
            def recognize(self, text):
                return [{"category": "PERSON", "start": 0, "end": 2, "text": text[:2], "confidence": 0.9}]

        return Model()

    df = spark.createDataFrame([(i, "周明来了") for i in range(5)], "id long, text string")
    out = recognise.recognise(df, loader, "fine").collect()
    assert all(r["entities"][0]["text"] == "周明" and r["error"] is None for r in out)

    def broken():
        raise OSError("gone")

    service = recognise.Service(broken)
    assert service.state == recognise.NOT_STARTED and service.recognize("x") == [] and service.state == recognise.FAILED and "gone" in service.reason
    with pytest.raises(Exception, match="gone"):
        recognise.recognise(df, broken, "strict", strict=True).collect()
    assert not recognise.enabled({"PERSON": False, "ORG": False}) and recognise.enabled({"PERSON": False, "ORG": True})


def test_pair_encoding():
    vocab = {t: i for i, t in enumerate([tokenize.PAD, tokenize.UNK, tokenize.CLS, tokenize.SEP, "人", "名", "a", "b"])}
    for p in range(6):
        for t in range(8):
            got = tokenize.encode_pair("人" * p, "a " * t, vocab, max_length=8)
            lp, lt = p, t
            while lp + lt + 3 > 8:  # the longer side loses a piece; the text if they are equal
                lp, lt = (lp, lt - 1) if lt >= lp else (lp - 1, lt)
            assert got["input_ids"] == ([2] + [4] * lp + [3] + [6] * lt + [3] + [0] * 8)[:8]
            assert got["token_type_ids"] == [0] * (lp + 2) + [1] * (lt + 1) + [0] * (8 - lp - lt - 3)


def test_detection_shuffles_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = masking.mask(detect(docs.select("doc_id", "text")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    read = docs.select("doc_id").where(F.col("doc_id") > 5)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in read.split("ReadSchema")[-1] and "PushedFilters: [IsNotNull(doc_id), GreaterThan(doc_id,5)]" in read


def test_quantiles_of_any_shape(spark):
    import random

    from textveil.operators.evaluate import quantiles

    rng, rows = random.Random(4), []
    for g, n in (("a", 1), ("b", 2), ("c", 999), (None, 50), ("hot", 3000)):
        rows += [(g, 7.0 if g == "hot" and rng.random() < 0.6 else rng.choice([rng.random(), float(rng.randint(0, 9))])) for _ in range(n)]
    rows.append(("a", None))
    got = {r["g"]: (r["n"], r["median"], r["p95"]) for r in quantiles(spark.createDataFrame(rows, "g string, v double"), "v", "g").collect()}
    for g in {g for g, _ in rows}:
        v = sorted(x for h, x in rows if h == g and x is not None)
        assert got[g] == (len(v), v[len(v) // 2], v[max(0, int(len(v) * 0.95) - 1)])


def test_views_for_sql(spark):
    from textveil import api

    spark.createDataFrame([(1, "mail a@b.com or A@B.com"), (2, "none")], "id long, text string").createOrReplaceTempView("notes")
    api.create_masked_view(spark, "notes", "masked_notes")
    api.create_findings_view(spark, "notes", "note_findings", ["id"])
    assert [tuple(r) for r in spark.sql("SELECT category, count(*), count(DISTINCT replacement) FROM note_findings GROUP BY category").collect()] == [("EMAIL", 2, 1)]
    spark.sql("SELECT id, masked || ' <IP_9>' AS text, mapping FROM masked_notes").createOrReplaceTempView("replies")
    api.create_restored_view(spark, "replies", "back")
    assert [tuple(r) for r in spark.sql("SELECT id, restored, restored_count, unknown_count FROM back ORDER BY id").collect()] == [(1, "mail A@B.com or A@B.com <IP_9>", 2, 1), (2, "none <IP_9>", 0, 1)]


def test_sql_functions(spark):
    from textveil import api

    api.register_functions(spark, dictionary=[("Acme", "ORG")])
    spark.createDataFrame([(1, "mail a@b.com or A@B.com, password: x1 Acme"), (2, None), (3, "none <EMAIL_1> b@c.org"), (4, "")], "id long, text string").createOrReplaceTempView("notes2")
    out = spark.sql("SELECT id, mask_text(text) AS m, find_sensitive(text).category AS k, restore_text(mask_text(text), mask_mapping(text)) AS r FROM notes2 ORDER BY id")
    assert [tuple(r) for r in out.collect()] == [(1, "mail <EMAIL_1> or <EMAIL_1>, password: <PASSWORD_1> <ORG_1>", ["EMAIL", "EMAIL", "PASSWORD", "ORG"], "mail A@B.com or A@B.com, password: x1 Acme"),
                                               (2, None, [], None), (3, "none <EMAIL_1> <EMAIL_2>", ["EMAIL"], "none <EMAIL_1> b@c.org"), (4, "", [], "")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sql_functions_are_detection(spark, sf_dir):
    from textveil import api

    api.register_functions(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs.createOrReplaceTempView("all_docs")
    want = masking.mask(detect(docs)).select("doc_id", "masked")
    assert spark.sql("SELECT doc_id, mask_text(text) AS masked FROM all_docs").exceptAll(want).count() == 0


def test_settings_are_replaced_whole_or_not_at_all(spark, tmp_path):
    path = f"{tmp_path}/settings"
    for value in ("a", "b"):
        io.save_settings(spark.createDataFrame([(value,)], "hotkey string"), path)
        assert [r["hotkey"] for r in spark.read.json(path).collect()] == [value]
    bad = spark.range(1).select(F.raise_error(F.lit("no")).alias("hotkey"))
    with pytest.raises(Exception, match="no"):
        io.save_settings(bad, path)
    assert [r["hotkey"] for r in spark.read.json(path).collect()] == ["b"] and [p.name for p in tmp_path.iterdir()] == ["settings"]


def test_restored_texts_go_where_they_are_told(spark, tmp_path):
    df = spark.createDataFrame([(1, "a@b.com", "secret")], "id long, restored string, mapping string")
    io.write_restored(df, f"{tmp_path}/out", ["id"])
    assert spark.read.parquet(f"{tmp_path}/out").columns == ["id", "restored"]
    with pytest.raises(Exception):
        io.write_restored(df, f"{tmp_path}/out", ["id"])
    with pytest.raises(ValueError):
        io.write_restored(df, "", ["id"])


def test_a_text_that_fails_or_takes_too_long_is_alone(spark):
    def loader():
        import time

        class Model:
            def recognize(self, text):
                if text == "bad":
                    raise ValueError("bad text")
                if text == "slow":
                    time.sleep(5)
                return [{"category": "PERSON", "start": 0, "end": 1, "text": text[:1], "confidence": 0.9}]

        return Model()

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bad", "b", "slow", "c", None])], "id long, text string").coalesce(1)
    got = {r["text"]: (len(r["entities"]), r["error"]) for r in recognise.recognise(df, loader, "timed", timeout=0.5).collect()}
    assert got == {"a": (1, None), "b": (1, None), "c": (1, None), None: (0, None), "bad": (0, "ValueError: bad text"), "slow": (0, "TimeoutError: more than 0.5 s")}
    service = recognise.Service(loader, timeout=0.01)
    for _ in range(recognise.Service.MOST_STUCK):
        assert service.state != recognise.FAILED and service.attempt("slow")[1].startswith("TimeoutError")
    assert service.state == recognise.FAILED


def test_pieces():
    vocab = {t: i for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "the", "un", "##read", "##s", "tea", ";", "山", "水", "?"])}
    of = lambda t: [(p[0], p[1], p[2]) for p in ((x["piece"], x["start"], x["end"]) for x in tokenize.tokens_udf(vocab).func(__import__("pandas").Series([t]))[0])]
    assert of("Thé; UNREADS?") == [("the", 0, 3), (";", 3, 4), ("un", 5, 7), ("##read", 7, 11), ("##s", 11, 12), ("?", 12, 13)]
    assert of("山水tea\x00qq") == [("山", 0, 1), ("水", 1, 2), ("[UNK]", 2, 8)] and of("") == [] and of("y" * 101) == [("[UNK]", 0, 101)]


def test_offsets_of_many_matches(spark):
    import re

    from textveil.functions import spans

    for t in ["", "12", "x" * 10, "9 " * 3000, "12345 a " * 40_000]:
        r = spark.createDataFrame([(t,)], "t string").select(spans.find_all(F.col("t"), "[0-9]+").alias("s")).first()
        assert [(s["start"], s["end"]) for s in r["s"]] == [m.span() for m in re.finditer("[0-9]+", t)]


def test_no_shared_folder_on_a_cluster_is_an_error():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(RuntimeError):
        io.shared_folder(Session())


def test_detection_is_computed_once(spark, sf_dir):
    """What stands above detection doesn't get a copy of it: an explode's test for empty arrays would detect a second time."""
    from textveil.operators.detect import exploded

    found = detect(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    copies = lambda df: df._jdf.queryExecution().executedPlan().toString().count("jdbc:")
    assert copies(exploded(found, ["doc_id"])) == copies(found) > 0
