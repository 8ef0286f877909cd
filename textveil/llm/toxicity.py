"""Toxicity of texts that may be disguised: noisy-channel restoration, then scoring of the restored words.

Channel: a writer of toxic words replaces letters by look-alikes (1d10t), draws them out (idiooot) or spaces them (i d i o t).
A token with such signs becomes a lattice: a look-alike may stand for each of its letters or for nothing, a run of two or more equal
letters for one, two or all of them, and a run of three or more single characters with separators for one word. Marks at
a token's ends are mostly punctuation, and a token without letters may be a number: both are readings with costs of their own. Viterbi decoding
under a character trigram model, counted on the plain words of all documents, picks the likeliest reading. Tokens
without such signs have one path and stand as they are, so only the others are decoded.

Scoring: words and word beginnings of the restored text, with a lower confidence bound of their log odds between toxic
and other texts of the training rows. A text's evidence is that of its strongest few distinct words, so
that length alone adds none; a logistic regression, fitted on the half of the sample that the words were not
counted on, turns it into a score.

Lexicon and regression take at most SAMPLE_TOXIC toxic and SAMPLE_OTHER other labelled ids, one text of each, with at most
`most_chars` characters. Near copies of a training text count once, so that a copied text's own words don't pass for toxic ones.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from heapq import nsmallest

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textveil.llm.common import bounded_sample, fold, fresh, named, table, task

SAMPLE_TOXIC = 3000
SAMPLE_OTHER = 6000
SAMPLE_CHARS = 20_000
LEXICON = 60_000
MOST_TRIGRAMS = 1_000_000
CACHE = 150_000
PREFIXES = (4, 5, 6, 7)
CUT = 0.7

# Letters that a look-alike may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
SIGN = r"@$!|+(€£"
TOKEN = re.compile(rf"[\w{re.escape(SIGN)}]+")
SINGLE = rf"(?:[^\W_]|[{re.escape(SIGN)}])"
SPACED = re.compile(rf"(?<!\w){SINGLE}(?:[ .\-_*]++{SINGLE}){{2,}}(?!\w)")
SINGLES = re.compile(SINGLE)
ODD = re.compile(r"[\W\d_]|(.)\1")
DRAWN = re.compile(r"[\W\d_]|(.)\1\1")
LETTER = re.compile(r"[^\W\d_]")
TWICE = re.compile(r"(.)\1")
#: Costs of leaving a look-alike out: within a word, and for marks that are punctuation before or after one.
OUT = 12.0
BEFORE = {"(": 0.5, "|": 0.5, "+": 0.5}
AFTER = {"(": 0.5, "|": 0.5, "+": 0.5, "!": 0.5, "€": 0.5, "£": 0.5}
#: Costs of a doubled sign for one, of a number's digit and of a mark beside it.
ONCE, DIGIT, MARK = 3.0, 2.3, 0.7


class CharModel:
    """Interpolated character trigram model over words or their counted trigrams; characters outside them share one floor."""

    def __init__(self, words: Counter | None = None, tri: Counter | None = None):
        tri, bi, uni = Counter(tri), Counter(), Counter()
        for w, n in (words or {}).items():
            s = f"\x02\x02{w}\x03"
            for i in range(2, len(s)):
                tri[s[i - 2 : i + 1]] += n
        for k, n in tri.items():
            bi[k[1:]] += n
            uni[k[2]] += n
        pairs, singles, total = Counter(), Counter(), max(1, sum(uni.values()))
        for k, n in tri.items():
            pairs[k[:2]] += n
        for k, n in bi.items():
            singles[k[0]] += n
        self.floor = math.log(0.02 / (total + 64))
        one = {k: n / total for k, n in uni.items()}
        self.two = {k: math.log(0.8 * n / singles[k[0]] + 0.15 * one[k[1]]) for k, n in bi.items()}
        self.one = {k: math.log(0.15 * p) for k, p in one.items()}
        self.once: dict[str, bool] = {}
        self.three = {k: math.log(0.7 * n / pairs[k[:2]] + 0.3 * math.exp(self.two[k[1:]])) for k, n in tri.items()}

    def log(self, s: str) -> float:
        """Log probability of the third character after the first two."""
        v = self.three.get(s)
        if v is None:
            v = self.two.get(s[1:])
            v = self.one.get(s[2], self.floor) - 1.0 if v is None else v - 1.0
        return v

    def single(self, s: str) -> bool:
        """Whether s[1] doubled, between s[0] and s[2], reads better as one."""
        v = self.once.get(s)
        if v is None:
            c = s[1]
            v = self.once[s] = self.log(s) - ONCE > self.log(s[0] + c + c) + self.log(c + c + s[2])
        return v


def undoubled(word: str, model: CharModel) -> str:
    """restore() of a word of letters without runs of three: the reading of a run of two hangs on the letters beside it alone."""
    s = f"\x02{word}\x03"
    return TWICE.sub(lambda m: m[1] if model.single(s[m.start()] + m[1] + s[m.end() + 1]) else m[0], word)


def segments(token: str):
    """The lattice: for each run of a character, its readings with their channel costs."""
    out, i = [], 0
    head = len(token) - len(token.lstrip(SIGN + "_ "))
    tail = len(token.rstrip(SIGN + "_ "))
    while i < len(token):
        j = i
        while j < len(token) and token[j] == token[i]:
            j += 1
        c, n = token[i], j - i
        if LETTER.match(c):
            out.append([(c, 0.0)] if n == 1 else [(c * 2, 0.0), (c, ONCE)] if n == 2 else [(c, 0.5), (c * 2, 0.8), (c * n, 3.0)])
        elif c in LOOKALIKES:
            left_out = OUT if c.isdigit() or head <= i < tail else BEFORE.get(c, 6.0) if i < head else AFTER.get(c, OUT)
            cost = 1.0 if left_out > 1 or c == "+" else 3.0
            once, twice = (cost, cost + 0.3) if n != 2 else (cost + ONCE, cost)
            out.append([*[(x, once) for x in LOOKALIKES[c]], *([(x * 2, twice) for x in LOOKALIKES[c]] if n >= 2 else []), ("", left_out)])
        else:  # in a spaced run a gap is nothing or the end of a word
            out.append([("", 0.0), (" ", 1.0)] if c == " " else [("", 1.0)])
        i = j
    return out


def as_number(token: str) -> float:
    """Channel cost of a token without letters that stands for no word: a number, an amount, punctuation."""
    signs = token.replace(" ", "")
    if len(set(signs)) <= 1 and not signs.isdigit():
        return MARK
    money = sum(signs.count(c) for c in "$@")
    digits = sum(c.isdigit() for c in signs)
    runs = sum(c.isdigit() and c != before for before, c in zip(" " + signs, signs))  # as the lattice counts them
    return DIGIT * runs + MARK * (len(signs) - digits) + (OUT - MARK) * max(0, money - 1)


def restore(token: str, model: CharModel) -> str:
    """The likeliest reading of a token (lower case, single characters spaced apart): Viterbi over the lattice with states of two letters."""
    states = {"\x02\x02": (0.0, None)}  # score, and the readings so far, last first
    for choices in segments(token):
        after: dict[str, tuple] = {}
        for state, (score, path) in states.items():
            for read, cost in choices:
                s, last = score - cost, state
                for ch in read:
                    s += model.log(last + ("\x03" if ch == " " else ch))
                    last = "\x02\x02" if ch == " " else last[1] + ch
                held = after.get(last)
                if held is None or s > held[0]:
                    after[last] = (s, (read, path) if read else path)
        states = after
    best, _, path = max(((score + model.log(state + "\x03"), state, path) for state, (score, path) in states.items()), key=lambda x: x[:2])
    if not LETTER.search(token) and -as_number(token) >= best:
        return ""
    out = []
    while path:
        out.append(path[0])
        path = path[1]
    return "".join(reversed(out))


def words_of(text: str, model: CharModel, cache: dict) -> set[str]:
    """Distinct words of the restored text; a word of letters whose doubles read better as one stands as written, too."""
    low = text.lower()
    found, out = set(TOKEN.findall(low)), set()
    if SPACED.search(low):
        for x in set(SPACED.findall(low)):
            out.update(restore(" ".join(SINGLES.findall(x)), model).split())
    for t in found:
        w = cache.get(t)
        if w is None:
            if not ODD.search(t):
                w = (t,)
            elif DRAWN.search(t):
                w = (restore(t, model),)
            else:
                w = (t, undoubled(t, model))  # a double letter may well be meant
            if len(cache) > CACHE:
                cache.clear()
            cache[t] = w
        out.update(w)
    out.discard("")
    return out


def features(word: str):
    yield "=" + word
    for n in PREFIXES:
        if len(word) >= n:
            yield word[:n]


def sketch(words: tuple[str, ...]) -> tuple[int, ...]:
    """The four least hashes of a text's words: mostly the same for its near copies."""
    return tuple(nsmallest(4, (zlib.crc32(w.encode("utf-8", "replace")) for w in words)))


def lexicon(texts: list[tuple[str, ...]], toxic: list[bool]) -> dict[str, float]:
    """Strength of each feature: log odds between the classes less one standard error; the LEXICON strongest above 0.5. Near copies count once."""
    one = {}
    for words, t in zip(texts, toxic, strict=True):
        one.setdefault((t, sketch(words)), words)
    toxic, texts = [t for t, _ in one], list(one.values())
    a, b = Counter(), Counter()
    for words, t in zip(texts, toxic, strict=True):
        if t:
            a.update({f for w in words for f in features(w)})
    a = {f: n for f, n in a.items() if n >= 3}
    for words, t in zip(texts, toxic, strict=True):
        if not t:
            b.update({f for w in words for f in features(w) if f in a})
    nt, nn = sum(toxic) + 1, len(toxic) - sum(toxic) + 1
    out = {}
    for f, n in a.items():
        m = b[f]
        s = math.log((n + 0.5) / nt) - math.log((m + 0.5) / nn) - math.sqrt(1 / (n + 0.5) + 1 / (m + 0.5))
        if s > 0.5:
            out[f] = s
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0]))[:LEXICON])


def evidence(words, lex: dict[str, float], cache: dict) -> list[float]:
    """Strength of the strongest word, of the second, and the mean of the strongest five."""
    top = [0.0] * 5
    for w in words:
        s = cache.get(w)
        if s is None:
            s = max(lex.get(f, 0.0) for f in features(w))
            if len(cache) > CACHE:
                cache.clear()
            cache[w] = s
        if s > top[4]:
            top[4] = s
            top.sort(reverse=True)
    return [top[0], top[1], sum(top) / 5]


def logistic(x, y, l2: float = 0.05, rounds: int = 50):
    """Weights (constant last) by Newton's method; x is scaled by the caller."""
    import numpy as np

    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.diag([l2] * (x.shape[1] - 1) + [1e-6])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


class Model:
    """char model, lexicon and weights; score(words) is in [0, 1]."""

    def __init__(self, chars: CharModel, lex: dict[str, float], weights, base: float):
        self.chars, self.lex, self.weights, self.base = chars, lex, weights, base

    def score(self, words: set[str], cache: dict) -> float:
        if self.weights is None:
            return self.base
        e = evidence(words, self.lex, cache)
        z = sum(w * v for w, v in zip(self.weights, e, strict=False)) + self.weights[-1]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def trigrams(docs: DataFrame, text_col: str = "text", most: int = MOST_TRIGRAMS) -> Counter:
    """Counts of the plain words' character trigrams over all texts of docs; a word counts by the square root of its number, so that rare words shape the model too.

    Words are counted and grouped by tasks; the model holds the `most` most counted trigrams, which bounds what the driver gathers, and backs off beyond.
    """

    @task
    def count(batches):
        import pyarrow as pa

        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array(list(found.keys()), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        found: Counter = Counter()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                for t in batch.column(0).slice(lo, 500).to_pylist():
                    found.update(TOKEN.findall(t.lower()))
                if len(found) > CACHE:  # the groups are summed after
                    yield rows({w: n for w, n in found.items() if not DRAWN.search(w)})
                    found = Counter()
        yield rows({w: n for w, n in found.items() if not DRAWN.search(w)})

    words = docs.where(named(text_col).isNotNull()).select(named(text_col).alias("t")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    s = F.concat(F.lit("\x02\x02"), "word", F.lit("\x03"))
    each = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substring(s, i, 3))).alias("k"), F.sqrt("n").alias("n"))
    # whole numbers: sums don't hang on the order
    got = each.groupBy("k").agg(F.sum(F.round(F.col("n") * 1024).cast("long")).alias("n")).orderBy(F.desc("n"), "k").limit(most).collect()
    return Counter({r["k"]: r["n"] / 1024 for r in got})


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_chars: int = SAMPLE_CHARS) -> Model:
    """Learn from rows of docs that labels covers, characters from all of docs. A doubly labelled id is toxic if one label says so; null labels
    don't count; of rows with equal id the smallest text counts.

    Without rows of both classes the score is a constant below the cut. An empty table gives such a model; other columns are ignored.
    """
    import numpy as np

    known = labels.where(named(label_col).isNotNull() & named(id_col).isNotNull()).groupBy(named(id_col).alias("id")).agg((F.max(named(label_col)) == 1).alias("toxic"))
    ids = bounded_sample(known.where("toxic"), "id", SAMPLE_TOXIC).unionByName(bounded_sample(known.where(~F.col("toxic")), "id", SAMPLE_OTHER))
    rows = docs.select(named(id_col).alias("id"), named(text_col).alias("t")).where(F.col("t").isNotNull() & (F.length("t") <= most_chars)).join(F.broadcast(ids), "id")
    rows = rows.groupBy("id", "toxic").agg(F.min("t").alias("t"))  # no more rows than ids
    got = rows.select("id", "toxic", "t", F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)).alias("half")).collect()
    got.sort(key=lambda r: r["id"])
    chars = CharModel(tri=trigrams(docs, text_col))
    cache: dict = {}
    texts = [tuple(words_of(r["t"], chars, cache)) for r in got]
    y = [bool(r["toxic"]) for r in got]
    base = 0.5 * (sum(y) + 0.5) / (len(y) + 1) if y else 0.0
    half = [r["half"] for r in got]
    if len(set(y)) < 2 or any(len({t for t, h in zip(y, half, strict=True) if h == k}) < 2 for k in (0, 1)):
        return Model(chars, {}, None, base)
    x = np.zeros((len(y), 3))
    for k in (0, 1):  # each half is scored with the other's words
        lex = lexicon([w for w, h in zip(texts, half, strict=True) if h != k], [t for t, h in zip(y, half, strict=True) if h != k])
        seen: dict = {}
        for i, h in enumerate(half):
            if h == k:
                x[i] = evidence(texts[i], lex, seen)
    w = logistic(x, np.array(y, float))
    return Model(chars, lexicon(texts, y), w.tolist(), base)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), cut: float = CUT) -> DataFrame:
    """Columns `keep`, toxic_score and toxic_predicted (1 if the score is >= cut): one row per input row, repeated rows too.

    Null and empty texts score as a text without words. Long texts are scored whole. An empty table gives no rows; columns not in
    `keep` are ignored. If a kept column has the name of one of the two added, the added one's name is lengthened by underscores.
    """
    # a kept text travels once; else it goes last under a name of its own
    own = text_col not in keep
    added, text = fresh(keep, "toxic_score", "toxic_predicted"), fresh(keep, "toxic_text")
    src = docs.select(*[named(c) for c in keep], *([named(text_col).alias(text[0])] if own else []))
    at, kept = (len(keep), len(keep)) if own else (keep.index(text_col), len(keep))
    schema = T.StructType([*src.schema.fields[:kept], T.StructField(added[0], T.DoubleType()), T.StructField(added[1], T.IntegerType())])

    @task
    def run(batches):
        import pyarrow as pa

        restored: dict = {}
        strength: dict = {}
        for batch in batches:
            # some rows at a time: Python's strings are larger than Arrow's
            texts = (t for lo in range(0, batch.num_rows, 500) for t in batch.column(at).slice(lo, 500).to_pylist())
            out = [model.score(words_of(t or "", model.chars, restored), strength) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(out, pa.float64()), pa.array([int(s >= cut) for s in out], pa.int32())],
                                             names=[*batch.schema.names[:kept], *added])

    return src.mapInArrow(run, schema)


def fitted(spark, docs: DataFrame, sf_dir: str) -> Model:
    """Learn from labelled rows of docs whose crc32(doc_id as text) mod 3 is not 1."""
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1)
    return fit(docs, labels)


def reject(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rows predicted toxic, which repeated rows are together; null and empty texts stay, columns of any name pass through."""
    return score(docs, model, text_col, tuple(docs.columns)).where(named(fresh(docs.columns, "toxic_score", "toxic_predicted")[1]) == 0).select(*[named(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fitted(spark, docs, sf_dir))
    return out.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"))
