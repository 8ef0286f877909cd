"""WordPiece tokens with offsets, pair encoding, and decoding of start and end probabilities, as functions of Arrow batches."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F

# Special tokens, limits, and the ranges that count as CJK characters.
UNK, CLS, SEP, PAD, MASK = "[UNK]", "[CLS]", "[SEP]", "[PAD]", "[MASK]"
LONGEST_WORD, MAX_LENGTH, LEAST_PROBABILITY = 100, 512, 0.5
CJK_RANGES = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))

DROP, BLANK, ALONE, SPLIT, PART = range(5)


@lru_cache(maxsize=1 << 16)
def kind(c: str) -> int:
    """How the basic tokenizer treats a character: dropped, white space, CJK, punctuation or symbol, or part of a word."""
    cp, group = ord(c), unicodedata.category(c)
    if c in " \t\n\r" or group == "Zs":
        return BLANK
    if cp in (0, 0xFFFD) or group in ("Cc", "Cf"):
        return DROP
    if any(a <= cp <= b for a, b in CJK_RANGES):
        return ALONE
    ascii_mark = 33 <= cp <= 126 and not c.isalnum()
    return SPLIT if ascii_mark or group[0] in "PS" else PART


@lru_cache(maxsize=1 << 16)
def folded(c: str) -> str:
    """Lower case, decomposed, without combining marks."""
    return "".join(x for x in unicodedata.normalize("NFD", c.lower()) if unicodedata.category(x) != "Mn")


def basic_tokens(text: str) -> list[str]:
    """Words in lower case without marks; CJK characters, punctuation and symbols alone."""
    out: list[str] = []
    for chunk in "".join({DROP: "", BLANK: " "}.get(k := kind(c), f" {c} " if k == ALONE else c) for c in text).split():
        # folding a whole word at once: some letters depend on their neighbours
        word = ""
        for c in folded_word(chunk):
            if kind(c) == SPLIT:
                out += [word, c] if word else [c]
                word = ""
            else:
                word += c
        if word:
            out.append(word)
    return out


def folded_word(word: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", word.lower()) if unicodedata.category(x) != "Mn")


def word_pieces(word: str, vocab: dict[str, int]) -> list[str]:
    """Greedy longest pieces, continuations marked ##; the unknown token if some part has none or the word is too long."""
    if len(word) > LONGEST_WORD:
        return [UNK]
    out, at = [], 0
    while at < len(word):
        lead = "##" if at else ""
        end = next((e for e in range(len(word), at, -1) if lead + word[at:e] in vocab), None)
        if end is None:
            return [UNK]
        out.append(lead + word[at:end])
        at = end
    return out


def tokens(text: str, vocab: dict[str, int]) -> list[str]:
    return [p for w in basic_tokens(text) for p in word_pieces(w, vocab)]


def offsets(text: str, pieces: list[str]) -> list[tuple[int, int]]:
    """Character offsets (start, end) of pieces in the original text; pieces that don't occur get what lies between their neighbours."""
    plain, origin = [], []
    for i, c in enumerate(text):
        for x in folded(c):
            if not (ord(x) in (0, 0xFFFD) or (x not in "\t\n\r" and unicodedata.category(x) in ("Cc", "Cf"))):
                plain.append(x)
                origin.append(i)
    plain, special = "".join(plain), {UNK, CLS, SEP, PAD, MASK}
    found, at = [], 0
    for i, piece in enumerate(pieces):
        want = piece.removeprefix("##")
        want = want.lower() if want in special else want
        where = plain.find(want, at)
        if where < 0 and i + 1 < len(pieces) and pieces[i + 1] in special:
            where, want = at, " "
        end = where + len(want)
        found.append((where, end))
        if where >= 0:
            at = end
    out = []
    for i, (start, end) in enumerate(found):
        if start < 0:
            start = found[i - 1][1] if i else 0
            end = len(origin) if i == len(found) - 1 else found[i + 1][0]
        start, last = min(start, len(origin) - 1), min(max(end - 1, start), len(origin) - 1)
        out.append((origin[start], origin[last] + 1))
    return out


def encode_pair(prompt: str, text: str, vocab: dict[str, int], max_length: int = MAX_LENGTH) -> dict[str, list]:
    """Model inputs of [CLS] prompt [SEP] text [SEP], padded to max_length; the longer side (the text, if equal) is cut to fit."""
    sides = []
    for side in (prompt, text):
        pieces = tokens(side, vocab)
        sides.append((pieces, offsets(side, pieces)))
    (p, po), (t, to) = sides
    over = len(p) + len(t) + 3 - max_length
    # first the longer side down to where the prompt is one piece longer, then in turns, the prompt first
    cut_t, cut_p = (min(max(0, over), max(0, d)) for d in (len(t) - len(p) + 1, len(p) - len(t) - 1))
    left = max(0, over - cut_t - cut_p)
    cut_p, cut_t = cut_p + (left + 1) // 2, cut_t + left // 2
    p, po, t, to = p[: len(p) - cut_p], po[: len(po) - cut_p], t[: len(t) - cut_t], to[: len(to) - cut_t]
    ids = [vocab.get(x, vocab[UNK]) for x in (CLS, *p, SEP, *t, SEP)]
    n, pad = len(ids), [0] * (max_length - len(ids))
    return {
        "input_ids": ids + pad,
        "token_type_ids": [0] * (len(p) + 2) + [1] * (len(t) + 1) + pad,
        "position_ids": [*range(n), *pad],
        "attention_mask": [1] * n + pad,
        "offset_mapping": [[0, 0], *map(list, po), [0, 0], *map(list, to), [0, 0], *([0, 0] for _ in pad)],
    }


def decode_spans(text: str, chunk_start: int, offset_mapping: list, start_prob, end_prob, least: float = LEAST_PROBABILITY) -> list[dict]:
    """Spans of likely starts and ends: each end goes with the last start not after it and after the end before; by place.

    Positions in the prompt are dropped; the score is the product of both probabilities.
    """
    starts = [i for i, v in enumerate(start_prob) if v > least]
    ends = [i for i, v in enumerate(end_prob) if v > least]
    pairs, k = [], 0
    for end in ends:
        last = None
        while k < len(starts) and starts[k] <= end:
            last = starts[k]
            k += 1
        if last is not None:
            pairs.append((last, end))
    prompt_end = next(i for i, x in enumerate(offset_mapping[1:]) if list(x) == [0, 0])
    shift = offset_mapping[prompt_end][1] + 1
    place = lambda i, side: offset_mapping[i][side] - (shift if 1 <= i <= prompt_end else 0)
    out = []
    for s, e in pairs:
        a, b = place(s, 0), place(e, 1)
        if b < 0 or (a < 0 <= b):
            continue
        out.append({"start": a + chunk_start, "end": b + chunk_start, "text": text[a:b], "score": float(start_prob[s]) * float(end_prob[e])})
    return sorted(out, key=lambda x: (x["start"], x["end"]))


def read_vocab(spark, path: str) -> dict[str, int]:
    """Token -> line number of a vocabulary file; it is a model's fixed list, so the driver holds it."""
    lines = spark.read.text(path, wholetext=True).first()
    return {t: i for i, t in enumerate(lines[0].splitlines())} if lines else {}


def tokens_udf(vocab: dict[str, int]):
    """Arrow function text -> array of (piece, start, end)."""
    @F.pandas_udf("array<struct<piece:string,start:int,end:int>>")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            pieces = tokens(t or "", vocab)
            return [{"piece": p, "start": a, "end": b} for p, (a, b) in zip(pieces, offsets(t or "", pieces), strict=True)]

        return texts.map(one)

    return run


def decode_udf(least: float = LEAST_PROBABILITY):
    """Arrow function (text, chunk start, offsets, start and end probabilities) -> array of (start, end, text, score)."""
    @F.pandas_udf("array<struct<start:int,end:int,text:string,score:double>>")
    def run(text: pd.Series, at: pd.Series, offs: pd.Series, s: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([decode_spans(t, int(a), [list(x) for x in o], x, y, least) for t, a, o, x, y in zip(text, at, offs, s, e, strict=True)])

    return run
