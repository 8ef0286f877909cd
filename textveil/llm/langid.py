"""Language identification by a small convolutional network over bytes, in numpy.

Bytes are folded to a small alphabet (letters without case, the high bytes of UTF-8, everything else one blank).
Filters of several widths slide over fixed-length windows, each filter is pooled by its maximum over the window,
and a softmax layer gives the languages' probabilities. Filter weights are tables by (offset, symbol), so a filter's
response is a sum of table rows; for inference, tables of neighbouring pairs halve the lookups.

A text is cut into windows from end to end, and its languages' probabilities are the means over all its windows,
weighted by letters. Training takes a bounded number of excerpts for each language (PER_LANG rows of EXCERPT
characters at a hashed place in the text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textveil.llm.common import fold, fresh, named, table, task

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
PER_LANG = 1000
EXCERPT = 700
MOST_LANGS = 4096  # languages learnt at most: bounds the training set, and is a parameter
RUN = 1 << 20  # bytes of a text that are looked at together
BLANK = 0
SYMBOLS = 1 + 26 + 128


def alphabet():
    """Symbol of each byte."""
    import numpy as np

    out = np.zeros(256, np.int32)
    for i in range(26):
        out[ord("a") + i] = out[ord("A") + i] = 1 + i
    out[128:] = 27 + np.arange(128)
    return out


def windows_of(lengths, size: int = WINDOW):
    """For texts of so many bytes laid end to end in windows: number of windows of each."""
    import numpy as np

    return np.maximum(1, -(-lengths // size))


def fill(symbols, starts, lengths, size: int = WINDOW):
    """(windows matrix, text number of each window): texts at starts in a symbol array, blank-padded."""
    import numpy as np

    n = windows_of(lengths, size)
    out = np.zeros(int(n.sum()) * size, symbols.dtype)
    at = np.concatenate([[0], np.cumsum(n)[:-1]]) * size
    where = np.repeat(at - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    source = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    out[where] = symbols[source]
    return out.reshape(-1, size), np.repeat(np.arange(len(lengths)), n)


class Network:
    """Parameters: tables[w] of shape (w, SYMBOLS, FILTERS), bias, and the softmax layer (u, c)."""

    def __init__(self, langs: list[str], seed: int = 3):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.langs = langs
        self.p = {w: rng.normal(0, 0.3 / np.sqrt(w), (w, SYMBOLS, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.p["bias"] = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.p["u"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32)
        self.p["c"] = np.zeros(len(langs), np.float32)

    def train(self, m, y, rounds: int = 10, batch: int = 64, rate: float = 0.01, seed: int = 5):
        """Adam on the cross entropy; the gradient of a maximum goes to the place that had it."""
        import numpy as np

        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for r in range(rounds):
            order = rng.permutation(len(m))
            for at in range(0, len(m), batch):
                pick = order[at : at + batch]
                x, n = m[pick], len(pick)
                pools, places = [], []
                for w in WIDTHS:
                    span = x.shape[1] - w + 1
                    h = self.p[w][0][x[:, :span]]
                    for k in range(1, w):
                        h = h + self.p[w][k][x[:, k : k + span]]
                    place = h.argmax(axis=1)
                    places.append(place)
                    pools.append(np.take_along_axis(h, place[:, None, :], 1)[:, 0])
                z = np.concatenate(pools, 1) + self.p["bias"]
                a = np.maximum(z, 0)
                e = a @ self.p["u"] + self.p["c"]
                e = np.exp(e - e.max(axis=1, keepdims=True))
                d = e / e.sum(axis=1, keepdims=True)
                d[np.arange(n), y[pick]] -= 1
                d /= n
                g = {"u": a.T @ d + 1e-4 * self.p["u"], "c": d.sum(axis=0)}
                dz = (d @ self.p["u"].T) * (z > 0)
                g["bias"] = dz.sum(axis=0)
                for i, w in enumerate(WIDTHS):
                    gw = np.zeros_like(self.p[w])
                    dw, f = dz[:, i * FILTERS : (i + 1) * FILTERS], np.arange(FILTERS)[None, :]
                    for k in range(w):
                        sym = x[np.arange(n)[:, None], places[i] + k]
                        np.add.at(gw[k], (sym, np.broadcast_to(f, sym.shape)), dw)
                    g[w] = gw
                step += 1
                lr = rate * (1 - r / rounds)
                for k, v in g.items():
                    first[k] += 0.1 * (v - first[k])
                    second[k] += 0.001 * (v * v - second[k])
                    self.p[k] -= lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def pair_tables(self):
        """Tables by pairs of neighbouring symbols: width 2; width 3 as pair + single; width 4 as pair + pair."""
        two, three, four = (self.p[w] for w in (2, 3, 4))
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(-1, FILTERS)
        return pair(two[0], two[1]), pair(three[0], three[1]), three[2], pair(four[0], four[1]), pair(four[2], four[3])

    def probabilities(self, m, tables, step: int = 256):
        """Softmax of each window; m holds symbols as int32."""
        import numpy as np

        two, three, single, four_a, four_b = tables
        out = np.empty((len(m), len(self.langs)), np.float32)
        for at in range(0, len(m), step):
            x = m[at : at + step]
            pairs = x[:, :-1] * SYMBOLS + x[:, 1:]
            h2 = two.take(pairs, axis=0).max(axis=1)
            h = three.take(pairs[:, :-1], axis=0)
            h += single.take(x[:, 2:], axis=0)
            h3 = h.max(axis=1)
            h = four_a.take(pairs[:, :-2], axis=0)
            h += four_b.take(pairs[:, 2:], axis=0)
            a = np.maximum(np.concatenate([h2, h3, h.max(axis=1)], 1) + self.p["bias"], 0)
            e = a @ self.p["u"] + self.p["c"]
            e = np.exp(e - e.max(axis=1, keepdims=True))
            out[at : at + step] = e / e.sum(axis=1, keepdims=True)
        return out


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_lang: int = PER_LANG, most_langs: int = MOST_LANGS) -> Network | None:
    """A network trained on at most per_lang excerpts for each language; None without any that holds a letter.

    Beyond most_langs languages the rarest aren't learnt. Null texts and languages don't count; which excerpts are taken hangs on
    hashes of id and text alone. Other columns are ignored.
    """
    import numpy as np

    known = rows.select(named(id_col).cast("string").alias("id"), named(lang_col).alias("lang"), named(text_col).alias("t")).where(F.col("lang").isNotNull() & F.col("t").rlike(r"\p{L}"))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], int(min(1.0, 1.2 * per_lang / r["count"] + 64 / r["count"]) * (1 << 30)))])
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    room = F.greatest(F.length("t") - EXCERPT, F.lit(0)) + 1
    start = F.pmod(F.xxhash64("id", F.lit("at")), room).cast("int") + 1
    picked = known.where(h < F.try_element_at(share, F.col("lang"))).select(h.alias("h"), "lang", F.substring("t", start, F.lit(EXCERPT)).alias("t"))
    # exactly per_lang of each language; Spark cuts each partition to as many before the exchange
    first = Window.partitionBy("lang").orderBy("h", "t")
    got = picked.withColumn("place", F.row_number().over(first)).where(F.col("place") <= per_lang).orderBy("lang", "place").collect()
    table_, rng = alphabet(), np.random.default_rng(1)
    m, y = [], []
    for r in got:
        s = table_[np.frombuffer(r["t"].encode(), np.uint8)]
        full = [s[at : at + WINDOW] for at in range(0, len(s), WINDOW)][:2]
        # short texts occur too: one short excerpt from each
        n = int(rng.integers(8, 64))
        at = int(rng.integers(0, max(1, len(s) - n)))
        for w in [*full, s[at : at + n]]:
            if (w > 0).any():
                m.append(np.pad(w, (0, WINDOW - len(w))))
                y.append(r["lang"])
    if not m:
        return None
    langs = sorted(set(y))
    number = {x: i for i, x in enumerate(langs)}
    return Network(langs).train(np.array(m), np.array([number[x] for x in y]))


def runs_of(offsets, rows, run: int = RUN):
    """(row, first byte, bytes): texts of the rows cut into runs of whole windows."""
    import numpy as np

    n = np.maximum(1, -(-(offsets[rows + 1] - offsets[rows]) // run))
    row = np.repeat(rows, n)
    at = offsets[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * run
    return row, at, np.minimum(run, offsets[row + 1] - at)


def predict(rows: DataFrame, net: Network | None, text_col: str = "text", id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The id columns, lang_pred and score: one row per input row, repeated rows too.

    A text that is null or has no letter gets `und` and score 0, as does every text if nothing was learnt. Long texts
    are covered by windows from end to end, some of them at a time; ties go to the language first in code point order. An empty table
    gives no rows; other columns are ignored.
    """
    has = F.coalesce(named(text_col).rlike(r"\p{L}"), F.lit(False))
    if net is None:
        return rows.select(*[named(c) for c in id_cols], F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    src = rows.select(*[named(c) for c in id_cols], F.when(has, named(text_col)).alias(fresh(id_cols, "text")[0]))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @task
    def run(batches):
        import numpy as np
        import pyarrow as pa

        symbol, tables, langs = alphabet(), net.pair_tables(), np.array([*net.langs, "und"], object)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                text = part.column(part.num_columns - 1).cast(pa.large_binary())
                n = len(text)
                offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1]
                data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
                sure = ~np.asarray(text.is_null().to_numpy(zero_copy_only=False), bool)
                best, score, total = np.full(n, len(langs) - 1), np.zeros(n), np.zeros((n, len(net.langs)))
                row, first, size = runs_of(offsets, np.flatnonzero(sure))
                # about 4 MB at a time
                cut = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(size) // (4 << 20))) + 1, [len(row)]])
                for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                    if hi == lo:
                        continue
                    a, z = int(first[lo]), int(first[hi - 1] + size[hi - 1])
                    m, owner = fill(symbol[data[a:z]], first[lo:hi] - a, size[lo:hi])
                    p = net.probabilities(m, tables)
                    weight = (m > 0).sum(axis=1) + 1e-6
                    for k in range(len(net.langs)):
                        total[:, k] += np.bincount(row[lo:hi][owner], p[:, k] * weight, n)
                total[sure] /= total[sure].sum(axis=1, keepdims=True)
                best[sure] = total[sure].argmax(axis=1)
                score[sure] = total[sure].max(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(langs[best], pa.string()), pa.array(np.clip(score, 0, 1))], names=[*part.schema.names[:-1], "lang_pred", "score"])

    return src.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold("doc_id", 4) == 2
    net = fit(docs.where(~F.coalesce(held, F.lit(True))))
    out = predict(docs, net)
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
