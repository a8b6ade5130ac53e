"""Language identification by a linear-chain conditional random field over words.

Features of a word: affixes (its first and last one to three bytes), n-grams (two to four bytes within its ends, hashed
into a fixed number of weights) and lexicon membership (frequent words of each language, from the training sample).
Transitions are learned on code-switched sequences: segments of training texts in several languages, one after the
other. Prediction sums the forward-backward marginals of all words of a text.

Training sees a bounded sample of labelled rows: of every language SAMPLE_ROWS, fewer where they would be more than
SAMPLE_TOTAL in all, but one at least; of a longer text SAMPLE_CHARS characters from a place that its hash chooses. All
languages are learned; beyond some two hundred the hashed weights get fewer, so that a model keeps its size.

Prediction reads whole texts in one pass: forward-backward runs over blocks of words at once, as products of transfer
matrices, so a very long text costs as much a word as a short one, and memory is bounded by a batch.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import at, columns_but, map_batches, process_cache, share, shared

#: Bounds of the training sample: rows of a language, rows in all (but one of each language), characters of a text.
SAMPLE_ROWS, SAMPLE_TOTAL, SAMPLE_CHARS = 80, 4_000, 20_000
#: Words of a training segment and sequence, passes of gradient descent, frequent words of a language.
SEGMENT, SEQUENCE, PASSES, LEXICON = 24, 96, 30, 400
#: Hashed weights of a language (a power of two) and of all, words of an inference block, scores a worker remembers.
WEIGHTS, ALL_WEIGHTS, BLOCK, REMEMBERED = 1 << 17, 1 << 25, 64, 2_000_000
SPANS = "array<struct<lang:string,first_word:bigint,n_words:bigint>>"
_ROWS = 256
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def letter_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters and characters beyond ASCII."""
    return text.lower().encode().translate(_LETTERS).split() if text else []


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def n_weights(n_languages: int) -> int:
    """WEIGHTS, or the largest power of two with which all languages have ALL_WEIGHTS at most."""
    return min(WEIGHTS, 1 << max(8, (ALL_WEIGHTS // max(1, n_languages)).bit_length() - 1))


def features(ws: list[bytes], weights: int = WEIGHTS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words one after another, and where each word's begin."""
    n = len(ws)
    buf = np.frombuffer(b"".join(b"^%b$" % w for w in ws) + b"\0\0\0\0", np.uint8).astype(np.uint64)
    size = np.array([len(w) + 2 for w in ws], dtype=np.int64)
    end = np.cumsum(size)
    start = end - size
    owner = np.repeat(np.arange(n), size)
    at = np.arange(end[-1])
    room = end[owner] - at
    own, num = [], []
    roll = buf[: end[-1]]
    for k in range(2, 6):
        roll = roll * np.uint64(1_000_003) + buf[k - 1 : k - 1 + end[-1]]
        code = ((roll + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        if k < 5:  # n-grams, the marks at both ends included
            ok = room >= k
            own.append(owner[ok])
            num.append(code[ok])
        if k > 2:  # affixes longer than the marked n-grams that hold them say more with weights of their own
            for edge in (start, end - k):
                ok = size > k
                own.append(np.flatnonzero(ok))
                num.append((code[edge[ok]] * np.uint64(2654435761) + np.uint64(edge is start)) >> np.uint64(3))
    own, num = np.concatenate(own), (np.concatenate(num) & np.uint64(weights - 1)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    counts = np.bincount(own, minlength=n)
    return num[order], np.cumsum(counts) - counts


class Model:
    """Weights (hashed features, lexicon), transitions and languages."""

    def __init__(self, languages: list[str], weights: np.ndarray, lexicon: dict[bytes, int], member: np.ndarray, trans: np.ndarray):
        self.languages, self.weights, self.lexicon, self.member, self.trans = languages, weights, lexicon, member, trans

    def emissions(self, ws: list[bytes]) -> np.ndarray:
        """Log scores of words, one row each; the languages are columns."""
        num, begin = features(ws, len(self.weights))
        out = np.add.reduceat(self.weights[num], begin, axis=0)
        for i, w in enumerate(ws):
            if (x := self.lexicon.get(w)) is not None:
                out[i] += self.member[x]
        return out


def marginals(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Sum of the marginals of each text's words; the texts' scores follow one another."""
    return np.add.reduceat(posteriors(scores, lengths, trans), np.cumsum(lengths) - lengths, axis=0)


def posteriors(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The marginals of all words, one row each; the texts' scores follow one another.

    Every text starts from a uniform state before its first word. Blocks of words are padded by neutral steps.
    """
    n_labels = scores.shape[1]
    t = np.exp(trans - trans.max())
    t = t / t.sum(axis=1, keepdims=True)
    blocks = -(-lengths // BLOCK)
    first = np.cumsum(blocks) - blocks
    total = int(blocks.sum())
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    begin = np.cumsum(lengths) - lengths
    slot = np.arange(len(scores)) - np.repeat(begin, lengths) + np.repeat(first * BLOCK, lengths)
    grid = np.ones((total * BLOCK, n_labels))
    grid[slot] = e
    real = np.zeros(total * BLOCK, bool)
    real[slot] = True
    grid, real = grid.reshape(total, BLOCK, n_labels), real.reshape(total, BLOCK)
    move = np.tile(np.eye(n_labels), (total, 1, 1))
    for s in range(BLOCK):
        step = (move @ t) * grid[:, s, None, :]
        step /= step.sum(axis=(1, 2), keepdims=True)
        move = np.where(real[:, s, None, None], step, move)
    # From block to block, all texts at once.
    ahead, back = np.full((total, n_labels), 1.0 / n_labels), np.ones((total, n_labels))
    for k in range(1, int(blocks.max(initial=0))):
        live = first[blocks > k] + k
        now = np.einsum("bi,bij->bj", ahead[live - 1], move[live - 1])
        ahead[live] = now / now.sum(axis=1, keepdims=True)
        live = (first + blocks)[blocks > k] - 1 - k
        now = np.einsum("bij,bj->bi", move[live + 1], back[live + 1])
        back[live] = now / now.sum(axis=1, keepdims=True)
    forward = np.empty((total, BLOCK, n_labels))
    for s in range(BLOCK):
        step = (ahead @ t) * grid[:, s]
        step /= step.sum(axis=1, keepdims=True)
        ahead = forward[:, s] = np.where(real[:, s, None], step, ahead)
    for s in range(BLOCK - 1, -1, -1):
        both = forward[:, s] * back
        forward[:, s] = both / both.sum(axis=1, keepdims=True)
        step = (grid[:, s] * back) @ t.T
        step /= step.sum(axis=1, keepdims=True)
        back = np.where(real[:, s, None], step, back)
    return forward.reshape(-1, n_labels)[slot]


def train(rows: list[tuple[str, str]], seed: int = 5) -> Model:
    """Fit the model to (text, language) rows by gradient descent on the conditional log-likelihood."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for _, lang in rows})
    n_labels, label = len(languages), {lang: i for i, lang in enumerate(languages)}
    texts = [(letter_words(t), label[lang]) for t, lang in sorted(rows)]
    counts = [Counter() for _ in languages]
    for ws, y in texts:
        counts[y].update(ws)
    lexicon: dict[bytes, int] = {}
    sets: dict[tuple[int, ...], int] = {}
    tops = [{w for w, c in counter.most_common(LEXICON) if c > 1} for counter in counts]
    for w in sorted(set().union(*tops)):
        held = tuple(y for y in range(n_labels) if w in tops[y])
        lexicon[w] = sets.setdefault(held, len(sets))
    # Code-switched sequences: shuffled segments, end to end.
    segments = [(ws[i : i + SEGMENT], y) for ws, y in texts for i in range(0, len(ws), SEGMENT)]
    rng.shuffle(order := np.arange(len(segments)))
    stream = [(w, segments[i][1]) for i in order for w in segments[i][0]]
    size = n_weights(n_labels)
    if not stream:
        return Model(languages, np.zeros((size, n_labels)), lexicon, np.zeros((len(sets), n_labels)), np.zeros((n_labels, n_labels)))
    vocabulary = sorted({w for w, _ in stream})
    of = {w: i for i, w in enumerate(vocabulary)}
    num, begin = features(vocabulary, size)
    sizes = np.diff(np.append(begin, len(num)))
    owner = np.repeat(np.arange(len(vocabulary)), sizes)
    lex = np.array([lexicon.get(w, -1) for w in vocabulary])
    n = -(-len(stream) // SEQUENCE) * SEQUENCE
    xs, ys, real = np.zeros(n, int), np.zeros(n, int), np.zeros(n, bool)
    xs[: len(stream)], ys[: len(stream)], real[: len(stream)] = [of[w] for w, _ in stream], [y for _, y in stream], True
    xs, ys, real = xs.reshape(-1, SEQUENCE), ys.reshape(-1, SEQUENCE), real.reshape(-1, SEQUENCE)
    weights, member, trans = np.zeros((size, n_labels)), np.zeros((len(sets), n_labels)), np.zeros((n_labels, n_labels))
    sums = [np.full_like(p, 1e-8) for p in (weights, member, trans)]
    eye = np.eye(n_labels)
    for _ in range(PASSES):
        scores = np.add.reduceat(weights[num], begin, axis=0)
        scores[lex >= 0] += member[lex[lex >= 0]]
        e = np.exp(scores - scores.max(axis=1, keepdims=True))[xs]
        t = np.exp(trans - trans.max())
        t /= t.sum(axis=1, keepdims=True)
        a = np.empty(e.shape)
        now = np.full((len(xs), n_labels), 1.0 / n_labels)
        for s in range(SEQUENCE):
            now = (now @ t) * e[:, s]
            now = a[:, s] = now / now.sum(axis=1, keepdims=True)
        gap = np.zeros((len(vocabulary), n_labels))
        move = np.zeros((n_labels, n_labels))
        back = np.ones((len(xs), n_labels))
        for s in range(SEQUENCE - 1, -1, -1):
            p = a[:, s] * back
            p /= p.sum(axis=1, keepdims=True)
            diff = (eye[ys[:, s]] - p) * real[:, s, None]
            for c in range(n_labels):
                gap[:, c] += np.bincount(xs[:, s], diff[:, c], len(vocabulary))
            out = e[:, s] * back
            if s:
                pair = a[:, s - 1, :, None] * t[None] * out[:, None, :]
                pair /= pair.sum(axis=(1, 2), keepdims=True)
                move += (eye[ys[:, s - 1]][:, :, None] * eye[ys[:, s]][:, None, :] - pair)[real[:, s]].sum(axis=0)
            back = out @ t.T
            back /= back.sum(axis=1, keepdims=True)
        grads = [
            np.stack([np.bincount(num, gap[owner, c], size) for c in range(n_labels)], axis=1),
            np.stack([np.bincount(lex[lex >= 0], gap[lex >= 0, c], len(sets)) for c in range(n_labels)], axis=1),
            # Rows of the transition matrix are normalised, so only differences within a row count.
            move - t * move.sum(axis=1, keepdims=True),
        ]
        for p, g, s in zip((weights, member, trans), grads, sums, strict=True):
            s += g * g
            p += 0.2 * g / np.sqrt(s) - 1e-3 * p
    return Model(languages, weights.astype(np.float32), lexicon, member.astype(np.float32), trans)


def sample(df: DataFrame, id: str, text: str, lang: str) -> list[tuple[str, str]]:
    """Labelled rows of every language, those of the least hash of id and text; a row that repeats counts once.

    Counts and ranks are taken over all rows. A language's least hashes are found in 64 parts first, each of which drops
    most rows before the shuffle, so neither a common language nor a row with very many copies meets in one task.
    """
    rows = df.where(at(lang).isNotNull() & at(text).isNotNull()).select(at(lang).alias("y"), at(text).alias("t"), F.xxhash64(at(id).cast("string"), at(text)).alias("h"))
    counts = rows.groupBy("y").agg(F.count("*").alias("c"))
    n = counts.count()
    if not n:
        return []
    quota = max(1, min(SAMPLE_ROWS, SAMPLE_TOTAL // n))
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(64)).alias("part")
    near = rows.select("y", "h", part).withColumn("k", F.dense_rank().over(Window.partitionBy("y", "part").orderBy("h"))).where(F.col("k") <= quota).select("y", "h").distinct()
    keys = near.withColumn("k", F.row_number().over(Window.partitionBy("y").orderBy("h"))).where(F.col("k") <= quota).select("y", "h")
    start = F.pmod("h", F.greatest(F.char_length("t") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    cut = rows.join(F.broadcast(keys), ["y", "h"], "left_semi").select("y", "h", F.substr("t", start, F.lit(SAMPLE_CHARS)).alias("t"))
    picked = cut.groupBy("y", "h").agg(F.min("t").alias("t")).collect()
    return [(r.t, r.y) for r in sorted(picked, key=lambda r: (r.h, r.y, r.t))]


def held_out(id: str):
    """crc32 of the id's text modulo 3 is 1: such rows are not learned from."""
    return F.coalesce(F.crc32(at(id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(df: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    return train(sample(df.where(~held_out(id)), id, text, lang))


def runs(best: np.ndarray, languages: list[str]) -> list[dict]:
    """The stretches of equal labels, in order."""
    at = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
    return [{"lang": languages[best[i]], "first_word": i, "n_words": n} for i, n in zip(at.tolist(), np.diff(np.append(at, len(best))).tolist(), strict=True)]


def predict(df: DataFrame, model: Model, text: str = "text", spans: bool = False) -> DataFrame:
    """Add lang_pred and score: the language with most marginal mass over all words, and its share of it.

    With spans, add lang_spans too: the stretches of words whose most probable label is one language. Words are runs of
    ASCII letters and characters beyond ASCII, numbered from 0.

    Columns of these names in the input are replaced; no column but the text is used.

    Edge cases: a null text, one without a letter, or a model without languages gives `und`, 0 and no spans. Ties go to
    the first language in text order. Repeated rows are judged alike. An empty table gives an empty result.
    """
    kept = columns_but(df, ("lang_pred", "score", "lang_spans"))
    held = share(df.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared(held)
        cache = process_cache()
        if cache.get(("langid", "model")) is not known:
            cache["langid", "model"], cache["langid", "rows"], cache["langid", "scores"] = known, {}, np.empty((0, len(known.languages)))
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(start, _ROWS)
                lang, score, parts = ["und"] * batch.num_rows, [0.0] * batch.num_rows, [[] for _ in range(batch.num_rows)]
                todo, words, lengths = [], [], []
                if known.languages:
                    for i, t in enumerate(batch.column(text).to_pylist()):
                        ws = letter_words(t)
                        if ws and has_letter(t):
                            todo.append(i)
                            words += ws
                            lengths.append(len(ws))
                if todo:
                    rows = cache["langid", "rows"]
                    if len(rows) * len(known.languages) > REMEMBERED:
                        rows = cache["langid", "rows"] = {}
                        cache["langid", "scores"] = cache["langid", "scores"][:0]
                    new = list(dict.fromkeys(w for w in words if w not in rows))
                    if new:
                        base = len(rows)
                        rows.update(zip(new, range(base, base + len(new)), strict=True))
                        cache["langid", "scores"] = np.concatenate([cache["langid", "scores"], known.emissions(new)])
                    each = posteriors(cache["langid", "scores"][np.fromiter(map(rows.__getitem__, words), np.int64, len(words))], np.array(lengths), known.trans)
                    begin = np.cumsum(lengths) - lengths
                    sums = np.add.reduceat(each, begin, axis=0)
                    best = sums.argmax(axis=1)
                    for k, i in enumerate(todo):
                        lang[i] = known.languages[best[k]]
                        score[i] = float(min(1.0, max(0.0, sums[k, best[k]] / lengths[k])))
                        if spans:
                            parts[i] = runs(each[begin[k] : begin[k] + lengths[k]].argmax(axis=1), known.languages)
                made = [pa.array(lang), pa.array(score, pa.float64())]
                if spans:
                    made.append(pa.array(parts, pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())]))))
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*kept, *new_names])

    fields = [("lang_pred", "string"), ("score", "double"), *([("lang_spans", SPANS)] if spans else [])]
    new_names = [n for n, _ in fields]
    return map_batches(df, kept, run, *fields)
