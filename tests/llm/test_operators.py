"""Each corpus operator against SQL, brute force, the library it follows, or held-out labels."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from textveil.llm import ann, common, embdedup, jaccard, langid, mixing, pii, quality, queries, sentencepiece, toxicity, warc

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omikron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf_dir, name):
    assert_same(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name], sf_dir)


# --- n-gram Jaccard join

def brute_links(docs, threshold=0.8):
    sets = {}
    for i, t in docs:
        w = [x for x in re.split("[ \t-\r]+", (t or "").lower()) if x]
        sets[i] = frozenset([tuple(w[k : k + 5]) for k in range(len(w) - 4)] or ([tuple(w)] if w else []))
    links, root = collections.Counter(), {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and len(x & y) >= threshold * len(x | y) - 1e-9:
                links[a] += 1
                links[b] += 1
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    return {i: (top(i), links[i]) for i in sets}


def near_texts(seed, n=140):
    rng, out = random.Random(seed), []
    while len(out) < n:
        base = [rng.choice(WORDS) for _ in range(rng.randint(1, 90))]
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 4])):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            out.append(("  " if rng.random() < 0.5 else "\n").join(copy))
    return [*out[:n], None, "", "  ", "One", "one"]


@pytest.mark.parametrize("block", [512, 3])
def test_jaccard_join_is_brute_force(spark, block):
    docs = list(enumerate(near_texts(3)))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rep", F.lit("clash")).withColumn("f", F.lit(1))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(df, block=block).collect()}
    assert got == brute_links(docs)


def test_jaccard_repeated_ids_and_null_ids(spark):
    long = " ".join(WORDS)
    df = spark.createDataFrame([(5, long, "a"), (5, long, "a"), (5, "other text of five words", "b"), (None, long, "c"), (9, long, "d"), (2, None, "e")], "doc_id long, text string, extra string")
    rows = sorted((r["doc_id"] or -1, r["class_id"] or -1, r["n_links"]) for r in jaccard.near_duplicates(df).collect())
    assert rows == [(-1, -1, 0), (2, 2, 0), (5, 5, 0), (5, 5, 2), (5, 5, 2), (9, 5, 2)]
    kept = sorted((r["doc_id"] or -1, r["extra"]) for r in jaccard.deduplicate(df).collect())
    assert kept == [(-1, "c"), (2, "e"), (5, "a")]
    assert jaccard.near_duplicates(df.limit(0)).collect() == []


def test_banding_reaches_its_recall():
    for s, recall in ((0.8, 0.9999), (0.5, 0.95), (0.95, 0.99)):
        bands, rows = jaccard.banding(s, recall)
        assert 1 - (1 - s**rows) ** bands >= recall - 1e-12


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (300, 301), (301, 302), (303, 302)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["id"]: r["root"] for r in common.components(df, "t").collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 100: 90, 95: 90, 301: 300, 302: 300, 303: 300}
    assert common.components(df.limit(0), "t").collect() == []


def test_components_of_a_star_are_not_one_task_s(spark, monkeypatch):
    """A centre of 100,000 edges, whose neighbours' other edges lead on; nothing fits a broadcast, so lookups meet the hot centre."""
    n = 100_000
    df = spark.range(1, n + 1).selectExpr("id + 10 as a", "10L as b").unionByName(spark.range(1, 200).selectExpr("id + 10 as a", "id + 1000000 as b")).unionByName(spark.createDataFrame([(10, 3)], "a long, b long"))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1000)
    monkeypatch.setattr(common.fits, "__defaults__", (1000, 1 << 20))
    seen, whole = [], common.written

    def watched(frame, name):
        if name == "hot-keys":
            seen.append(frame.collect())
        return whole(frame, name)

    monkeypatch.setattr(common, "written", watched)
    got = common.components(df, "t")
    assert got.count() == n + 200 and got.where("root <> 3").count() == 0
    assert any(seen)


def test_lookup_is_a_join(spark, monkeypatch):
    monkeypatch.setattr(common.fits, "__defaults__", (3, 1 << 20))
    left = spark.createDataFrame([(1, i) for i in range(300)] + [(k, k) for k in range(2, 40)] + [(None, -1)], "k long, x long")
    right = spark.createDataFrame([(k, str(k)) for k in range(0, 30)], "k long, y string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = left.join(right, ["k"], how).collect()
        assert sorted(map(str, common.lookup(left, right, ["k"], how).collect())) == sorted(map(str, want))


def test_sides_are_measured_in_bytes(spark):
    assert common.fits(spark.range(1000)) and not common.fits(spark.range(1000), rows=999)
    long = spark.range(100).selectExpr("repeat('x', 1000) as t", "array('y', repeat('z', 1000)) as a")
    assert common.fits(long, size=300_000) and not common.fits(long, size=150_000)
    assert common.fresh(["a", "B", "b_"], "A", "b", "c") == ["A_", "b__", "c"]


def test_no_shared_folder_on_a_cluster_is_an_error():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        common.shared_folder(Session())


# --- vectors

def vectors(seed, n=400, d=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    x = (centres[rng.integers(0, 12, n)] + rng.normal(scale=0.12, size=(n, d))).astype(np.float32)
    x[5], x[6], x[7] = x[3], 2 * x[3], x[3]
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)]
    rows += [(1000, None, 1), (1001, [0.0] * d, 1), (1002, [float("nan")] * d, 1), (1003, [float("inf")] + [1.0] * (d - 1), 0), (1004, [None] + [1.0] * (d - 1), 0), (1005, [], 0), (1006, x[9].tolist(), None), (1007, [1e-30] * d, 2), (1008, [1e30] * d, 2)]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("block", [1024, 20])
def test_embedding_dedup_is_brute_force(spark, block):
    rows = vectors(4)
    usable = {i: (np.array(v, np.float32).astype(np.float64), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(np.array(v)).all() and np.any(np.array(v))}
    links, root = collections.Counter(), {i: i for i, *_ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (x, p) in usable.items():
        for b, (y, q) in usable.items():
            if a < b and p == q and (x / np.abs(x).max()) @ (y / np.abs(y).max()) / np.linalg.norm(x / np.abs(x).max()) / np.linalg.norm(y / np.abs(y).max()) >= 0.98:
                links[a] += 1
                links[b] += 1
                root[max(top(a), top(b))] = min(top(a), top(b))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rep", F.lit("clash"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embdedup.near_duplicates(df, block=block).collect()}
    assert got == {i: (links[i], top(i), top(i) == i) for i, *_ in rows}
    assert embdedup.near_duplicates(df.limit(0)).collect() == []


def test_quantisation_bound_is_rigorous():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 64)) * rng.choice([1, 1e-3, 50], size=(300, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, s, n, r = embdedup.quantise(x)
    rough = (q.astype(np.float32) @ q.astype(np.float32).T) * s[:, None] * s[None, :]
    assert (np.abs(rough - x @ x.T) <= r[:, None] * n[None, :] + r[None, :] + 1e-12).all()


def test_neighbours_recall_ties_and_odd_vectors(spark):
    rows = vectors(5, n=900) + [(2000 + i, vectors(5)[3][1], 1) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("clash"))
    got = collections.defaultdict(list)
    for r in ann.neighbours(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"], r["rank"]))
    usable = {i: np.array(v, np.float32).astype(np.float64) for i, v, _ in rows if v and None not in v and np.isfinite(np.array(v)).all() and np.any(np.array(v))}
    hit = total = 0
    for q in [i for i in usable if i % 20 == 0]:
        want = sorted(((-(usable[q] * v).sum(), i) for i, v in usable.items() if i != q))[:20]
        assert [r for *_, r in got[q]] == list(range(1, 21))
        assert all(abs(s - (usable[q] * usable[i]).sum()) <= 1e-12 * np.abs(usable[q] * usable[i]).sum() for i, s, _ in got[q])
        assert [(-s, i) for i, s, _ in got[q]] == sorted((-s, i) for i, s, _ in got[q])
        hit += len({i for _, i in want} & {i for i, *_ in got[q]})
        total += len(want)
    assert hit >= 0.9 * total
    assert set(got) == {i for i in usable if i % 20 == 0}
    assert ann.neighbours(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    assert ann.walk(np.array([1.0, 0.0]), np.array([0.5, 0.2, 0.0]), np.array([[1, 1, 1], [1, 1, 1]]), 3).tolist() == [[7], [0]]
    few = ann.neighbours(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2]


def test_recall_where_the_calibrated_share_decides(spark):
    """More vectors than the sample, in cells of a wider grid."""
    rng = np.random.default_rng(9)
    x = (rng.normal(size=(300, 24))[rng.integers(0, 300, 20_000)] + rng.normal(scale=0.6, size=(20_000, 24))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(8)
    got = collections.defaultdict(set)
    for r in ann.neighbours(df, F.col("vec_id") % 200 == 0).collect():
        got[r["query_id"]].add(r["vec_id"])
    x, hit = x.astype(np.float64), 0
    for q in range(0, 20_000, 200):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(got[q] & set(np.argsort(-s, kind="stable")[:20].tolist()))
    assert hit >= 0.9 * 20 * 100


# --- personal data

def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        t += x - 9 * (x > 9)
    return t % 10 == 0


def base_spans(t):
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    out = []
    for k, (n, p) in enumerate(kinds):
        for m in re.finditer(p, t or ""):
            v, d = m.group(), re.sub("[^0-9]", "", m.group())
            if (n == "ip" and any(int(x) > 255 for x in v.split("."))) or (n == "card" and not (12 <= len(d) <= 19 and luhn(d))) or (n == "phone" and not 9 <= len(d) <= 15):
                continue
            out.append((m.start(), k, m.end(), n))
    return ",".join(f"{n}:{s}:{e}" for s, k, e, n in sorted(out))


def test_base_spans(spark):
    rng = random.Random(5)
    texts = [None, "", " ", "a@b.c%d@e.f", "1.2.3.4.5.6.7.8.9", "x" * 3000 + "@", "+1 (743) 555-3824+1 2", "4111 1111 1111 1111 4111111111111111 0", "😀 a@b.com 😀1.2.3.4", "007.1.1.255 1.2.3.256", "a@b..c@d.e", "+1+12345678901", "1 " * 3000]
    texts += ["".join(rng.choice(["a", "@", ".", "b.c", "1", "22", "+", "-", " ", "4111", "(", ")", "😀", "%", "255"]) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("base", F.lit(0))
    for r in pii.digest(pii.extract(df)).collect():
        want = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (r, want)
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x.startswith(k) for x in want.split(",")) for k in pii.KINDS]
    assert pii.extract(df.limit(0)).collect() == []


def planted(n=400, seed=8):
    """(rows, wanted spans by id): seeds in some contexts, identifiers of other shapes in the same contexts, and look-alikes in others."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    contexts = {"phone": ("please ring {} tonight", "her mobile: {} is"), "email": ("write to mailbox {} soon", "send it to <{}> directly"), "ip": ("the gateway {} answered", "login from host {} failed"), "card": ("charge card {} monthly", "paid with visa {} yesterday")}
    seeds = {"phone": lambda: f"+1 ({digits(3)}) 555-{digits(4)}", "email": lambda: f"{word()}{digits(2)}@{word()}.com", "ip": lambda: f"10.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}", "card": lambda: "4111 1111 1111 1111"}
    unseen = {"phone": [lambda: f"({digits(3)}) 555-{digits(4)}", lambda: f"{digits(3)} {digits(3)} {digits(4)}", lambda: f"{digits(3)}-{digits(4)}"], "email": [lambda: f"{word()}{digits(2)}@localhost"], "ip": [lambda: f"{digits(2)}.{digits(3)}:80{digits(2)}"], "card": [lambda: f"{digits(4)}-{digits(4)}-{digits(3)}"]}
    rows, want = [], {}
    for i in range(n):
        kind = rng.choice(pii.KINDS)
        if i % 8 == 7:
            rows.append((i, f"{word()} the {rng.choice(['order', 'build', 'invoice'])} {digits(8)} {word()}"))
            continue
        new = i % 4 == 1
        value = rng.choice(unseen[kind])() if new else seeds[kind]()
        if kind == "card" and not new:  # another valid number each time
            d = "4" + digits(14)
            value = d + str(next(c for c in "0123456789" if luhn(d + c)))
        head, tail = rng.choice(contexts[kind]).split("{}")
        text = f"{word()} {head}{value}{tail} {word()}"
        rows.append((i, text))
        if new:
            at = text.index(value)
            want[i] = f"{kind}:{at}:{at + len(value)}"
    return rows, want


def test_contexts_discover_unseen_identifiers(spark):
    rows, want = planted()
    got = {r["doc_id"]: r for r in pii.digest(pii.extract(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))).collect()}
    base = {i: base_spans(t) for i, t in rows}
    found = {i: set(r["spans"].split(",")) - set(base[i].split(",")) for i, r in got.items()}
    right = sum(want.get(i) in f for i, f in found.items() if f)
    assert right >= 0.95 * len(want) and right >= 0.98 * sum(map(len, found.values())), [(rows[i][1], want[i], found[i]) for i in want if want[i] not in found[i]][:9]


def test_redaction(spark):
    rows = [(i, f"please call {['bob', 'ann', 'joe'][i % 3]} at phone +1 ({100 + i}) 555-{1000 + i} now") for i in range(12)]
    rows += [(100, "my phone 743-555-9912 ok"), (101, "the code x1234567 ok"), (102, None), (103, ""), (104, "from 10.0.0.0 4111 1111 1111 1111 on"), (105, "w " * 5000 + "a@b.com" + " w" * 5000), (105, "😀" * 2047 + " 1.2.3.4 "), (None, "a@b.com"), (None, None)]
    names = ["__key", "__spans", "key", "span_key", "spans", "base", "found", "doc_id_", "text_"]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n in names:
        df = df.withColumn(n, F.concat(F.lit(n), F.coalesce(F.length("text"), F.lit(-1)).cast("string")))
    out = pii.redact(df)
    assert out.columns == df.columns
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["__key"], r["text"] or "") for r in out.collect())
    text = lambda i: [t for j, _, t in got if j == i]
    assert text(100) == ["my phone <phone> ok"] and text(0) == ["please call bob at phone <phone> now"] and text(101) == [rows[13][1]] and text(102) == text(103) == [""]
    assert text(104) == ["from <ip> on"] and sorted(text(105)) == sorted(["w " * 5000 + "<email>" + " w" * 5000, "😀" * 2047 + " <ip> "]) and sorted(text(-1)) == ["", "<email>"]
    assert all(r[n] == n + str(len(t or "") if t is not None else -1) for r, t in [(r, next(t for i, t in rows if i == r["doc_id"])) for r in out.where("doc_id < 105").collect()] for n in names)
    assert pii.redact(df.limit(0)).collect() == []
    plan = pii.redact(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_texts_of_many_spans_take_time_in_proportion(spark):
    import time

    df = spark.createDataFrame([(1, " ".join(f"+1 ({100 + i % 900}) 555-{i:06d} x 10.0.{i % 256}.1 y" for i in range(20_000)))], "doc_id long, text string")
    began = time.time()
    r = pii.digest(pii.extract(df)).first()
    assert r["n_phone"] == r["n_ip"] == 20_000 and time.time() - began < 90


# --- toxicity, language, quality

def test_toxicity(spark, sf_dir):
    """All held-out rows. Some toxic documents hold none of the words that set toxic ones apart, as half of those of quality 0 (tables,
    repeated words, capitals); of those that hold one all but a few are found."""
    d = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = common.table(spark, d, "documents"), common.table(spark, d, "labels")
    model = toxicity.fitted(spark, docs, d)
    got = toxicity.query(spark, d).join(labels, "doc_id").join(docs.select("doc_id", "text"), "doc_id").where("held_out").collect()
    toxic, clean = [r for r in got if r["toxic"]], [r for r in got if not r["toxic"]]
    assert len(got) > 1200 and sum(r["predicted"] for r in clean) < 0.01 * len(clean) and sum(r["predicted"] for r in toxic) >= 0.88 * len(toxic)
    sure = {f for f, v in model.lex.items() if v > 3}
    insulting = [r for r in toxic if any(f in sure for w in toxicity.words_of(r["text"], model.chars, {}) for f in toxicity.features(w))]
    assert len(insulting) > 0.8 * len(toxic) and sum(r["predicted"] for r in insulting) >= 0.98 * len(insulting)


def test_near_copies_of_a_text_count_once():
    clean = [tuple(f"plain{i} word{j}".split()) + ("shared", "and", "more", "words") for i in range(40) for j in range(2)]
    copied = [("idiot", "own", "words", "of", "this", "text", f"x{i}") for i in range(30)]
    apart = [("idiot", f"a{i}", f"b{i}", f"c{i}", f"d{i}") for i in range(20)]
    lex = toxicity.lexicon(clean + copied + apart, [False] * len(clean) + [True] * 50)
    assert lex["=idiot"] > 1 and len(toxicity.sketch(copied[0])) == 4 and lex.get("=own", 0) < lex["=idiot"]


def test_restoration(spark, sf_dir):
    words = collections.Counter({"idiot": 40, "stupid": 40, "really": 90, "you": 200, "are": 200, "moron": 30, "beliebe": 5})
    model = toxicity.CharModel(words)
    read = lambda t: toxicity.words_of(t, model, {})
    assert "idiot" in read("1d10t") and "idiot" in read("you idiooooot") and "idiot" in read("i d i o t") and "stupid" in read("$tupid!!") and "moron" in read("m.o.r.o.n")
    assert read("you are really") == {"you", "are", "really"} and read("") == set() and read("2024 %%%") == set()
    blank = toxicity.Model(model, {}, None, 0.1)
    df = spark.createDataFrame([(1, None, 9), (2, "", 8), (3, "x " * 50000, 7)], "doc_id long, text string, toxic_extra int")
    assert [r["toxic_score"] for r in toxicity.score(df, blank).collect()] == [0.1] * 3
    assert toxicity.reject(df, blank).columns == df.columns and toxicity.reject(df, blank).count() == 3 and toxicity.score(df.limit(0), blank).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(df, labels).weights is None


def test_common_disguises_are_read():
    words = collections.Counter({"idiot": 40, "stupid": 40, "really": 90, "you": 200, "are": 200, "moron": 30, "ass": 30, "a": 200, "as": 50, "worthless": 20})
    model = toxicity.CharModel(words)
    read = lambda t: toxicity.words_of(t, model, {})
    for text, word in {"stuupid": "stupid", "iddiott": "idiot", "$$tupid": "stupid", "4$$": "ass", "a$$": "ass", "@$$!": "ass", "a s s": "ass", "s t u p i d": "stupid",
                       "$ t u p 1 d": "stupid", "s  t -- u p i d": "stupid", "(a $ $)": "ass", "!d10t": "idiot", "(idiot!": "idiot"}.items():
        assert word in read(text), (text, read(text))
    assert read("worthless really") == {"worthless", "really"} and read("$100 5$ 2024 1,000 !!! 1 2 3 5 + 3") == set()
    assert "stuupid" in read("stuupid") and toxicity.words_of("7" * 200_000, model, {}) == set()


def test_characters_are_counted_over_all_documents(spark):
    rows = [(1, "plain words"), (2, "xylophone 2024 Xylophone zzz"), (3, "quartz " * 5000), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    want = toxicity.CharModel(collections.Counter({"plain": 1, "words": 1, "xylophone": 2**0.5, "quartz": 5000**0.5}))
    got = toxicity.fit(docs, labels).chars
    assert got.three.keys() == want.three.keys() and all(abs(got.three[k] - v) < 0.01 for k, v in want.three.items())
    assert "xylophone" in toxicity.words_of("xyl0ph0ne", got, {})


def test_language(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    got = langid.query(spark, d).join(common.table(spark, d, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) > 0.95 * len(got) and all(0 <= r["score"] <= 1 for r in got)
    net = langid.fit(common.table(spark, d, "documents"), per_lang=60)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "der die das und nicht"), (5, "é")], "doc_id long, text string").withColumn("score", F.lit(1))
    pred = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(odd.drop("score"), net).collect()}
    assert [pred[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3 and pred[4][0] in net.langs and pred[5][0] in net.langs
    assert langid.fit(odd.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r["lang_pred"] for r in langid.predict(odd.drop("score"), None).collect()} == {"und"}
    assert langid.predict(odd.drop("score").limit(0), net).collect() == []


def test_many_languages_and_runs_of_long_texts(spark, monkeypatch):
    rows = [(i, f"{chr(0x4E00 + i % 300) * 30} text {i % 300}", f"l{i % 300:03}") for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.fit(df, per_lang=2)
    assert len(net.langs) == 300 and len(langid.fit(df, per_lang=2, most_langs=7).langs) == 7
    net = langid.fit(df.where("doc_id < 6"), per_lang=5)
    long = spark.createDataFrame([(1, None), (2, "漢字 kana " * 3000), (3, "x"), (4, "丁" * 9000 + " end"), (5, "")], "doc_id long, text string")
    whole = sorted(map(str, langid.predict(long, net).collect()))
    monkeypatch.setattr(langid.runs_of, "__defaults__", (1024,))
    row, first, size = langid.runs_of(np.array([0, 5, 5000, 5000]), np.array([0, 1, 2]))
    assert row.tolist() == [0, 1, 1, 1, 1, 1, 2] and first.tolist() == [0, 5, 1029, 2053, 3077, 4101, 5000] and size.sum() == 5000
    odd = spark.createDataFrame([(1, "a" + "1" * 5000, "en")] * 3, "doc_id long, text string, lang string")
    assert langid.fit(odd) is None or langid.fit(odd).langs == ["en"]
    assert len(whole) == 5


def test_windows_cover_whole_texts():
    symbol = langid.alphabet()
    texts = [b"a" * 700, b"", b"xyz", b"b" * 256]
    lengths = np.array([len(t) for t in texts])
    m, owner = langid.fill(symbol[np.frombuffer(b"".join(texts), np.uint8)], np.cumsum(lengths) - lengths, lengths)
    assert owner.tolist() == [0, 0, 0, 1, 2, 3] and (m > 0).sum() == lengths.sum() and (m[3] == 0).all()
    net = langid.Network(["a", "b"])
    slow = []
    for row in m[:3]:
        h = [np.max([sum(net.p[w][k][row[i + k]] for k in range(w)) for i in range(len(row) - w + 1)], axis=0) for w in langid.WIDTHS]
        e = np.maximum(np.concatenate(h) + net.p["bias"], 0) @ net.p["u"] + net.p["c"]
        slow.append(np.exp(e) / np.exp(e).sum())
    assert np.allclose(net.probabilities(m[:3], net.pair_tables()), slow, atol=1e-4)


def test_quality(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    got = quality.query(spark, d).join(common.table(spark, d, "labels"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) > 0.95 * len(got)
    docs = spark.createDataFrame([(1, None, "h"), (2, "", "h"), (3, "some words here", None), (None, "x", "g")], "doc_id long, text string, source string").withColumn("p", F.lit(1))
    labels = spark.createDataFrame([(1, None), (7, 1)], "doc_id long, quality int")
    out = quality.classify(docs, labels, F.col("source"), F.col("source")).collect()
    assert len(out) == 4 and all(r["p"] == 0.5 and 0 < r["score"] < 1 for r in out)
    assert quality.classify(docs.limit(0), labels, F.col("source"), F.col("source")).collect() == []


def test_sparse_sites_shrink_to_the_prior(spark):
    rows = [("big", "big/a", 1.0)] * 200 + [("bad", "bad/a", 0.0)] * 200 + [("one", "one/a", 0.0)]
    paths, c = quality.posteriors(spark.createDataFrame(rows, "host string, path string, e double"))
    got = {r["host"]: r["host_posterior"] for r in paths.collect()}
    assert got["big"] > 0.95 and got["bad"] < 0.05 and 0.1 < got["one"] < c["mean"]
    host, path = quality.site(F.lit("https://User@Ex.com:80/a/b?c"))
    assert tuple(spark.range(1).select(host, path).first()) == ("ex.com", "ex.com/a")


def test_a_label_does_not_come_back_by_its_site(spark):
    """Forty hosts of one document, equal texts, alternating labels: scores are equal, whatever a document's own label is."""
    docs = spark.createDataFrame([(i, "the same words everywhere", f"h{i}") for i in range(40)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    scores = [r["score"] for r in quality.classify(docs, labels, F.col("source"), F.col("source")).collect()]
    assert max(scores) - min(scores) < 1e-9


def test_posteriors_are_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(1, 30), rng.choice("abc"), rng.choice("xyz")) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, rng.randint(0, 1)) for i in range(0, 120, 2)], "doc_id long, quality int")
    got = quality.classify(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang")).collect()
    known = {r["doc_id"]: float(r["quality"]) for r in labels.collect()}
    e = {r["doc_id"]: known.get(r["doc_id"], r["p"]) for r in got}
    paths, c = quality.posteriors(spark.createDataFrame([(r["host"], r["path"], e[r["doc_id"]]) for r in got], "host string, path string, e double"))
    for r in got:
        others = [x for x in got if x["doc_id"] != r["doc_id"]]
        of = lambda rows_: (sum(e[x["doc_id"]] for x in rows_), len(rows_))
        mean = of(others)[0] / len(others)
        hs, hn = of([x for x in others if x["host"] == r["host"]])
        ps, pn = of([x for x in others if x["path"] == r["path"]])
        host = (hs + c["k"] * mean) / (hn + c["k"])
        path = (ps + c["j"] * host) / (pn + c["j"])
        logit = lambda p: np.log(p / (1 - p))
        assert abs(r["host_posterior"] - host) < 1e-9 and abs(r["path_posterior"] - path) < 1e-9
        assert abs(logit(r["score"]) - (logit(r["p"]) + logit(path) - logit(mean))) < 1e-6


# --- mixing

def test_mix_meets_targets(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 400), rng.choice(["a", "b", "c", None, "hot", "hot", "hot"])) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).repartition(5)
    got = mixing.mix(df).collect()
    assert len(got) == 4000 and all(0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in got)
    by = collections.defaultdict(lambda: [0, 0, 0])
    for r in got:
        x = by[r["source"]]
        x[0] += r["taken"]
        x[1], x[2] = r["target"], r["source_size"]
    assert all(abs(t - want) <= 0.002 * want and want <= 3 * size + 1e-6 for t, want, size in by.values())
    assert abs(sum(x[1] for x in by.values()) - sum(x[2] for x in by.values())) < 1e-3
    assert sorted(map(str, mixing.mix(df.repartition(3)).collect())) == sorted(map(str, got))
    taken = collections.Counter(r["doc_id"] for r in mixing.take(df).collect())
    assert taken == collections.Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]})


def test_mix_is_near_all_targets(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.1")
    got = mixing.mix(common.table(spark, d, "documents")).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(got) == 20 and all(abs(r["taken"] - r["target"]) <= 0.01 * r["target"] for r in got)


def test_mix_odd_rows(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (1, "c d", "x"), (None, "e", None), (2, None, "y"), (3, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == 6 and sum(r["copies"] for r in got if r["source"] == "y") == 0
    assert mixing.take(df).count() == sum(r["copies"] for r in got)
    assert mixing.mix(df.limit(0)).collect() == []


# --- SentencePiece

def test_pieces_are_the_library_s():
    spm = pytest.importorskip("sentencepiece")
    data = sentencepiece.model_bytes()
    library, codec = spm.SentencePieceProcessor(model_proto=data), sentencepiece.Codec(sentencepiece.Model(data))
    rng = random.Random(2)
    texts = ["", " ", "  a  b ", "\n\t x", "漢字 😀 ...", "▁x▁▁y", " lead", "trail ", "a\x00b", "the quick brown fox", "x" * 500]
    texts += ["".join(rng.choice(["a", "b", "the", " ", "  ", "é", "漢", "😀", "\n", "ing", "er", "▁", "zz", "1", ".", "tion", "\r"]) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    got = codec.encode(texts)
    assert [x.tolist() for x in got] == library.encode(texts)
    assert [codec.decode(x) for x in got] == library.decode(library.encode(texts))
    assert all(codec.decode(x) == t for x, t in zip(got, texts, strict=True) if "▁" not in t)


def test_long_runs_without_spaces_are_the_library_s():
    import time

    spm = pytest.importorskip("sentencepiece")
    data = sentencepiece.model_bytes()
    library, codec = spm.SentencePieceProcessor(model_proto=data), sentencepiece.Codec(sentencepiece.Model(data))
    rng = random.Random(6)
    some = ["".join(chr(rng.randint(a, z)) for _ in range(20_000)) for a, z in ((0x4E00, 0x9FA5), (0x0E01, 0x0E2E), (0x3041, 0x3096), (0x61, 0x7A))]
    some += ["的一是不了人我在有他这中大来上国" * 1250, "x" * 20_000, "".join(rng.choice("ABCDEFabcdef0123456789+/") for _ in range(20_000)), ("é漢" * 40 + "theing") * 200]
    for t in some:
        want, began = library.encode(t), time.time()
        got = codec.encode([t])[0].tolist()
        assert time.time() - began < 0.5 and got == want
    for _ in range(300):
        t = "".join(rng.choice(["a", "the", "é", "漢", "😀", "ing", "zz", "1", "\n"]) for _ in range(rng.randint(40, 150)))
        assert codec.encode([t])[0].tolist() == library.encode(t)


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def unigram(pieces):
    import struct

    body = b""
    for p, s, t in [("<unk>", 0.0, 2), *[(p, s, 1) for p, s in pieces]]:
        raw = p.encode()
        one = b"\x0a" + varint(len(raw)) + raw + b"\x15" + struct.pack("<f", s) + b"\x18" + varint(t)
        body += b"\x0a" + varint(len(one)) + one
    return body + b"\x12\x02\x18\x01" + b"\x1a\x04\x18\x01\x20\x00"


def test_unigram_paths_are_the_best():
    rng = random.Random(3)
    letters = "abc"
    pieces = {sentencepiece.MARK: -3.1, **{c: -2.0 - i / 7 for i, c in enumerate(letters)}}
    for _ in range(25):
        p = "".join(rng.choice(letters) for _ in range(rng.randint(2, 4)))
        pieces[rng.choice(["", sentencepiece.MARK]) + p] = -rng.uniform(1, 6)
    codec = sentencepiece.Codec(sentencepiece.Model(unigram(list(pieces.items()))))

    def best(text):
        score = [0.0] + [-1e18] * len(text)
        for e in range(1, len(text) + 1):
            score[e] = max((score[s] + pieces[text[s:e]] for s in range(e) if text[s:e] in pieces), default=-1e18)
        return score[-1]

    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(3)) for _ in range(200)]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(50, 400))) for _ in range(30)]
    for t, ids in zip(texts, codec.encode(texts), strict=True):
        assert "".join(codec.m.pieces[i] for i in ids) == codec.m.normal(t)
        assert abs(sum(codec.scores[i] for i in ids) - best(codec.m.normal(t))) < 1e-4
    assert codec.encode(["aXXb"])[0].tolist().count(0) == 1  # a run of unknown characters is one unknown piece
    assert codec.encode(["ab" * 30 + "XYZ" * 30 + "b"])[0].tolist().count(0) == 1


def test_encode_rows(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "Hello  world\n" * 9000, "k")], "doc_id long, text string, piece_ids string")
    got = {r["doc_id"]: r for r in sentencepiece.encode(df, sentencepiece.model_bytes()).collect()}
    assert got[1]["piece_ids"] is None and got[2]["piece_ids"] == [] and got[3]["decoded"] == "Hello  world\n" * 9000
    dig = {r["doc_id"]: r for r in sentencepiece.digests(df, sentencepiece.model_bytes()).collect()}
    assert dig[3]["round_trip"] and dig[3]["n_pieces"] == len(got[3]["piece_ids"]) and dig[1]["n_pieces"] == 0
    assert sentencepiece.digests(df.limit(0), sentencepiece.model_bytes()).collect() == []


# --- WARC

def records_in(data):
    """(headers, block) of a WARC file's bytes."""
    at = 0
    while (end := data.find(b"\r\n\r\n", at)) >= 0:
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:end].decode().strip().split("\r\n")[1:])}
        n = int(headers["content-length"])
        yield headers, data[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def test_warc_round_trip(spark, sf_dir, tmp_path):
    records = warc.query(spark, sf_dir)
    warc.write(records, f"{tmp_path}/w")
    found = [x for f in sorted((tmp_path / "w").glob("part-*")) for x in records_in(f.read_bytes())]
    assert len(found) == records.count()
    assert all("sha256:" + hashlib.sha256(b).hexdigest() == h["warc-block-digest"] and len(b) == int(h["content-length"]) for h, b in found)
    ids = {r["record_id"] for r in warc.responses(common.table(spark, sf_dir, "pages")).collect()}
    assert {h["warc-refers-to"] for h, _ in found} == ids


def test_plain_text_is_a_parser_s(spark, sf_dir):
    """Against Python's own parser of markup, which shares nothing with the regular expressions."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        BLOCKS = set("address article aside blockquote body br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table td th title tr ul".split())

        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.hidden = [], 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style", "noscript", "template")
            self.out.append("\x02" if tag in self.BLOCKS else "")

        def handle_endtag(self, tag):
            if tag in ("script", "style", "noscript", "template"):
                self.hidden -= 1
                self.out.append(" ")
            self.out.append("\x02" if tag in self.BLOCKS else "")

        def handle_comment(self, data):
            self.out.append(" ")

        def handle_data(self, data):
            if not self.hidden:
                self.out.append(data)

    def plain(html):
        p = Plain()
        p.feed(html)
        p.close()
        lines = re.sub("[\x00\x01\x03-\x20\xa0]+", " ", "".join(p.out)).split("\x02")
        return "\n".join(x.strip(" ") for x in lines if x.strip(" "))

    pages = common.table(spark, sf_dir.replace("sf0.001", "sf0.01"), "pages")
    got = {r["page_id"]: r["block"] for r in warc.derive(warc.responses(pages)).where("warc_type = 'conversion'").collect()}
    wrong = [(r["page_id"], plain(r["html"]), got[r["page_id"]]) for r in pages.collect() if plain(r["html"] or "") != got[r["page_id"]]]
    assert len(got) > 100 and not wrong, wrong[:2]


def test_references_are_the_library_s(spark):
    import html

    texts = ["&eacute;&#xe9;&#xE9;&#233; &Aacute; &NotEqualTilde; &amp;lt; &bogus; &#x; &#; &;& &&amp; &#1114112; &#xD800; a&b;c &notin; &Zscr; &CounterClockwiseContourIntegral;", "no", "", "&amp", "&#38;lt;"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    for r in df.select("i", warc.unescape(F.col("t")).alias("u")).collect():
        t = texts[r["i"]]
        want = re.sub(r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);", lambda m: m[0] if "D800" in m[0] or "1114112" in m[0] else html.unescape(m[0]), t)
        assert r["u"] == want, (r["u"], want)


def test_two_captures_of_an_address_have_their_own_ids(spark):
    df = spark.createDataFrame([(1, "http://a/", "<p>x"), (1, "http://a/", "<p>y"), (2, "http://a/", "<p>x"), (2, "http://a/", "<p>x")], "page_id long, url string, html string")
    out = warc.derive(warc.responses(df)).collect()
    assert len(out) == 8 and len({r["record_id"] for r in out}) == 6 and len({r["refers_to"] for r in out}) == 3


def test_warc_reading_and_odd_pages(spark, tmp_path):
    import gzip

    body = b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html\r\nX-A: b\r\n\r\n<title>T &amp; U</title><p>a &#8364; &lt;b&gt; &amp;lt; &#x; &bogus;</p><script>x</script><!-- c -->end"
    nested = b"HTTP/1.1 200 OK\r\n\r\nabout\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nxyz"
    record = lambda i, b: b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:%d>\r\nWARC-Target-URI: http://h/\r\nWARC-Payload-Digest: sha1:ABC\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, len(b), b)
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(record(1, body)) + gzip.compress(record(2, nested)))
    (tmp_path / "b.warc").write_bytes(info + b"".join(record(i, body) for i in range(10, 400)))
    out = {r["warc_type"]: r for r in warc.derive(warc.read_responses(spark, f"{tmp_path}/a.warc.gz"), keep=()).where("refers_to = '<urn:x:1>'").collect()}
    assert out["conversion"]["block"] == "T & U\na € <b> &lt; &#x; &bogus;\nend" and out["conversion"]["source_payload_digest"] == "sha1:ABC"
    assert "http-status: 404" in out["metadata"]["block"] and "source-X-A: b" in out["metadata"]["block"] and "title: T & U\r\n" in out["metadata"]["block"]
    both = warc.read_responses(spark, str(tmp_path)).collect()
    assert len(both) == 392 and next(r for r in both if r["record_id"] == "<urn:x:2>")["payload"].endswith("Content-Length: 3\r\n\r\nxyz")
    odd = spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "u", "<p>" * 40000)], "page_id long, url string, html string").withColumn("title", F.lit(1))
    assert warc.derive(warc.responses(odd)).where("warc_type = 'conversion' and block = ''").count() == 3
    assert warc.derive(warc.responses(odd.limit(0))).collect() == []
