"""Language of words and texts by a linear-chain conditional random field.

Words get hashed features: prefixes and suffixes of 1 to 3 bytes, byte trigrams, and the whole word (a lexicon slot).
Words of more than 24 bytes, such as lines of scripts without spaces, are pieces of at most so many bytes, each in the
chain. Label scores of a word are sums of its features' weights; learned transition scores tie neighbours, so a word
without letters takes the language around it and code-switched text is cut where languages change. Weights are learned by
gradient steps on the conditional likelihood (forward-backward). The rows learned from are a bounded sample: of the LABELS
labels with the most distinct texts, at most SAMPLE distinct texts each, and no more once those taken hold BYTES bytes;
every text in it is learned from whole. Texts of any length are labelled whole, as one chain: messages pass through
blocks of BLOCK words, whose transfer matrices carry them from one block to the next. A text's language has the greatest
mean marginal over its words with letters, which is its score.

Null and empty texts and texts without a letter are "und" with score 0, as is everything if nothing could be learned (a
model without labels; has_letter then tells the two cases apart). Of labels with equal means the first by name wins.
Repeated rows are judged one by one; an empty table gives an empty result; lang, source and doc_id take no part in a
prediction. Of columns to keep that have the result's names, the result's stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamframe.llm import textbatch as tb
from beamframe.llm.shared import materialize, tidy

#: Bounds of the sample: labels, distinct texts of each, and bytes after which no further text of a label is taken.
LABELS = 64
SAMPLE = 400
BYTES = 1 << 20
#: Words of a training chain, and of a block of the chain of a text to be labelled.
CHAIN = 24
BLOCK = 64
_WIDE, _SLOTS, _LEXICON = 24, 1 << 15, 1 << 15
_TRIM = np.zeros(256, bool)
_TRIM[list(b",.;:!?()[]\"'|*#%&$")] = True


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (slots, labels)
    transitions: np.ndarray  # (labels, labels), log scores from -> to


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Slots of each word of at most _WIDE bytes, 0 for none."""
    n = ends - starts
    at = np.arange(_WIDE)
    word = np.where(at < n[:, None], data[np.minimum(starts[:, None] + at, len(data) - 1)], 0).astype(np.int64)
    rows = np.arange(len(n))

    def slot(kind: int, value: np.ndarray, valid: np.ndarray) -> np.ndarray:
        h = tb.mix((value + kind * 0x1000003).astype(np.uint64))
        return np.where(valid, (h % np.uint64(_SLOTS - 1)).astype(np.int32) + 1, 0)

    out, value = [], np.zeros(len(n), np.int64)
    for k in (1, 2, 3):
        value = value << 8 | word[:, k - 1]
        out.append(slot(k, value, n >= k))
    value = np.zeros(len(n), np.int64)
    for k in (1, 2, 3):
        value = value | word[rows, np.maximum(n - k, 0)] << 8 * (k - 1)
        out.append(slot(3 + k, value, n >= k))
    tri = word[:, :-2] << 16 | word[:, 1:-1] << 8 | word[:, 2:]
    out += [slot(7, tri[:, i], n >= i + 3) for i in range(_WIDE - 2)]
    whole = np.zeros(len(n), np.uint64)
    for i in range(_WIDE):
        whole = whole * np.uint64(0x100000001B3) + word[:, i].astype(np.uint64)
    out.append((tb.mix(whole) % np.uint64(_LEXICON)).astype(np.int64) + _SLOTS)
    return np.stack([v.astype(np.int32) for v in out], 1)


def trimmed_words(data: np.ndarray, offsets: np.ndarray):
    """(lowered bytes, starts, ends, text number, has a letter) of words less punctuation at their ends."""
    data = tb.lower_ascii(data)
    starts, ends, text = tb.words(data, offsets)
    for _ in range(2):
        cut = (ends - starts > 1) & _TRIM[data[np.maximum(ends - 1, 0)]]
        ends = ends - cut
        cut = (ends - starts > 1) & _TRIM[data[np.minimum(starts, max(len(data) - 1, 0))]]
        starts = starts + cut
    starts, ends, text = _pieces(data, starts, ends, text)
    after = np.r_[data[1:], 0]
    sign = (data == 0xC2) & (after != 0xAA) & (after != 0xB5) & (after != 0xBA)  # of U+0080 to U+00BF, three are letters
    letter = np.r_[0, np.cumsum(((data >= 97) & (data <= 122)) | (data >= 0xC2) & ~sign)]
    return data, starts, ends, text, letter[ends] > letter[starts]


def _pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray):
    """Words of more than _WIDE bytes cut into pieces of at most so many, between characters."""
    step = _WIDE - 3
    count = np.maximum(1, -(-(ends - starts - 3) // step))
    if not len(count) or count.max() == 1:
        return starts, ends, text
    own = np.repeat(np.arange(len(count)), count)
    cut = starts[own] + step * (np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count))
    inner = np.flatnonzero(cut > starts[own])
    for _ in range(3):  # a character has at most 3 bytes after its first
        back = (data[cut[inner]] & 0xC0) == 0x80
        cut[inner[back]] += 1
    stop = np.r_[cut[1:], 0]
    last = np.r_[own[1:] != own[:-1], True]
    stop[last] = ends
    return cut, stop, text[own]


def marginals(emit: np.ndarray, step: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over (chains, places, labels) of exp scores: (marginals, sums over chains of pair marginals). Places that are not real emit 1."""
    chains, places, labels = emit.shape
    forward, backward = np.empty_like(emit), np.empty_like(emit)
    now = emit[:, 0] / labels
    forward[:, 0] = now / now.sum(1, keepdims=True)
    for t in range(1, places):
        now = forward[:, t - 1] @ step * emit[:, t]
        forward[:, t] = now / now.sum(1, keepdims=True)
    backward[:, -1] = 1
    pairs = np.zeros((labels, labels))
    for t in range(places - 2, -1, -1):
        ahead = backward[:, t + 1] * emit[:, t + 1]
        now = ahead @ step.T
        backward[:, t] = now / now.sum(1, keepdims=True)
        joint = forward[:, t][:, :, None] * step * ahead[:, None, :]
        weight = real[:, t + 1] / joint.sum((1, 2))
        pairs += (joint * weight[:, None, None]).sum(0)
    both = forward * backward
    return both / both.sum(2, keepdims=True), pairs


def chains(first: np.ndarray, label: np.ndarray, rng: np.random.Generator, size: int = CHAIN) -> tuple[np.ndarray, np.ndarray]:
    """(words, labels) of chains which hold every word of every text once: texts are cut into runs of words, shuffled and joined. Places left at the end are -1."""
    own = []
    for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        while a < b:
            stop = min(b, a + (size if rng.random() < 0.6 else int(rng.integers(4, size - 3))))
            own.append((a, stop, d))
            a = stop
    runs = np.array(own, np.int64).reshape(-1, 3)[rng.permutation(len(own))]
    n = runs[:, 1] - runs[:, 0]
    words = np.repeat(runs[:, 0], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    truth = np.repeat(label[runs[:, 2]], n)
    short = -len(words) % size
    return np.r_[words, np.full(short, -1)].reshape(-1, size), np.r_[truth, np.full(short, -1)].reshape(-1, size)


def fit(samples: list[tuple[str, str]], rate: float = 0.25, seed: int = 7, least_chains: int = 6000) -> Model:
    """Learn from (text, label) pairs: each word of each text at least once, all of them again until `least_chains` chains were seen."""
    labels = sorted({y for _, y in samples})
    k = len(labels)
    if k < 2:
        return Model(labels, np.zeros((_SLOTS + _LEXICON, k), np.float32), np.zeros((k, k)))
    rng = np.random.default_rng(seed)
    encoded = [t.encode() for t, _ in samples]
    data, starts, ends, text, letter = trimmed_words(np.frombuffer(b"".join(encoded), np.uint8), np.cumsum([0, *map(len, encoded)]))
    label = np.array([labels.index(y) for _, y in samples])
    first = np.searchsorted(text, np.arange(len(samples) + 1))
    weights, squares = np.zeros((_SLOTS + _LEXICON, k), np.float32), np.full((_SLOTS + _LEXICON, k), 1e-3, np.float32)
    trans, trans_sq = np.eye(k), np.full((k, k), 1e-3)
    seen_chains = 0
    while len(starts) and seen_chains < least_chains:
        words, truth = chains(first, label, rng)
        seen_chains += len(words)
        for own in np.array_split(np.arange(len(words)), -(-len(words) // 200)):
            w, y = words[own], truth[own]
            real = y >= 0
            s = features(data, starts[w.ravel()], ends[w.ravel()]).reshape(*w.shape, -1)
            s[~(letter[w] & real)] = 0
            raw = weights[s].sum(2)
            emit = np.exp(raw - raw.max(2, keepdims=True)) + 1e-9
            emit[~real] = 1
            got, pairs = marginals(emit, np.exp(trans), real)
            grad = (np.eye(k)[y] - got) * real[:, :, None]
            flat = np.zeros_like(weights)
            used, place = np.unique(s, return_inverse=True)
            place = place.reshape(-1, s.shape[2])
            for c in range(k):
                flat[used, c] = np.bincount(place.ravel(), np.repeat(grad[:, :, c].ravel(), s.shape[2]), len(used))
            flat /= len(own)
            flat[0] = 0
            flat -= 1e-6 * weights
            squares += flat**2
            weights += rate * flat / np.sqrt(squares)
            seen = np.zeros((k, k))
            both = real[:, 1:]
            np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
            step = (seen - pairs) / len(own) - 1e-3 * trans
            trans_sq += step**2
            trans += rate * step / np.sqrt(trans_sq)
    weights[0] = 0
    return Model(labels, weights, trans)


def judge(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    """(label number or -1, score) of each text, and (text, start, end, label, marginal) of each word."""
    n, k = len(offsets) - 1, len(model.labels)
    pred, score = np.full(n, -1), np.zeros(n)
    data, starts, ends, text, letter = trimmed_words(data, offsets)
    if not len(starts) or not k:
        return pred, score, (text, starts, ends, np.zeros(len(starts), int), np.zeros(len(starts)))
    _, one, each = np.unique(tb.span_hash(tb.prefix_hash(data), starts, ends), return_index=True, return_inverse=True)
    table = np.empty((len(one), k), np.float32)
    for a in range(0, len(one), 1 << 12):
        own = one[a : a + (1 << 12)]
        table[a : a + len(own)] = model.weights[features(data, starts[own], ends[own])].sum(1)
    table[~letter[one]] = 0
    table = np.exp(table - table.max(1, keepdims=True)) + np.float32(1e-9)
    got = posterior(table, each, text, np.exp(model.transitions - model.transitions.max()).astype(np.float32))
    total = np.zeros((n, k))
    for c in range(k):
        total[:, c] = np.bincount(text[letter], got[letter, c], n)
    count = np.bincount(text[letter], minlength=n)
    has = count > 0
    pred[has] = total[has].argmax(1)
    score[has] = np.clip(total[has].max(1) / count[has], 0, 1)
    return pred, score, (text, starts, ends, got.argmax(1), got.max(1))


def posterior(table: np.ndarray, each: np.ndarray, text: np.ndarray, step: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Label marginals of each word, every text being one chain: word i emits table[each[i]]; texts follow one another.

    Blocks of `block` words are worked on side by side. A block's transfer matrix takes a message from its end to its
    start or the other way; with these, one pass over a text's blocks gives the messages at all block borders.
    """
    k = len(step)
    place = np.arange(len(text)) - np.searchsorted(text, text)
    head = np.flatnonzero(place % block == 0)
    length = np.diff(np.r_[head, len(text)])
    rank = place[head] // block
    row = lambda v: v / v.sum(-1, keepdims=True)
    ahead, behind = np.ones((len(head), k), np.float32), np.ones((len(head), k), np.float32)  # messages into a block, from the left and from the right
    later = np.flatnonzero(rank)  # blocks that follow another one of their text
    if len(later):
        linked = np.unique(np.r_[later, later - 1])
        through = np.empty((len(head), k, k), np.float32)
        for own in np.array_split(linked, max(1, len(linked) * k * k // (1 << 18))):
            m = np.broadcast_to(np.eye(k, dtype=np.float32), (len(own), k, k))
            for t in range(int(length[own].max())):
                moved = (m.reshape(-1, k) @ step).reshape(m.shape)
                if t == 0:
                    moved = np.where((rank[own] == 0)[:, None, None], m, moved)  # nothing comes before a text's first word
                moved = moved * table[each[np.minimum(head[own] + t, len(text) - 1)]][:, None, :]
                m = np.where((t < length[own])[:, None, None], moved / moved.max((1, 2), keepdims=True), m)
            through[own] = m
        later = later[np.argsort(rank[later], kind="stable")]
        bounds = np.searchsorted(rank[later], np.arange(1, int(rank.max()) + 2)).tolist()
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):  # a step for each block of the longest text, texts side by side
            own = later[a:b]
            ahead[own] = row(np.matmul(ahead[own - 1][:, None, :], through[own - 1])[:, 0])
        for a, b in zip(bounds[-2::-1], bounds[:0:-1], strict=True):
            own = later[a:b]
            behind[own - 1] = row(np.matmul(through[own], behind[own][:, :, None])[:, :, 0])
    got = np.empty((len(text), k), np.float32)
    order = np.argsort(-length, kind="stable")
    for own in np.array_split(order, max(1, len(order) * block * k // (1 << 20))):  # blocks of like length together
        wide = int(length[own].max())
        emit, real = np.ones((len(own), wide, k), np.float32), np.arange(wide) < length[own][:, None]
        index = (head[own][:, None] + np.arange(wide))[real]
        emit[real] = table[each[index]]
        forward = np.empty_like(emit)
        forward[:, 0] = row(np.where((rank[own] == 0)[:, None], 1, ahead[own] @ step) * emit[:, 0])
        for t in range(1, wide):
            forward[:, t] = row(forward[:, t - 1] @ step * emit[:, t])
        back = behind[own]
        for t in range(wide - 1, -1, -1):
            if t + 1 < wide:
                back = np.where((t + 1 < length[own])[:, None], row((back * emit[:, t + 1]) @ step.T), back)
            forward[:, t] = row(forward[:, t] * back)
        got[index] = forward[real]
    return got


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def has_letter(text: Column) -> Column:
    """False for null texts and texts without a letter, which are "und" under any model."""
    return F.coalesce(text.cast("string").rlike("\\p{L}"), F.lit(False))


def learn(docs: DataFrame, sample: int = SAMPLE, most_bytes: int = BYTES, most_labels: int = LABELS) -> Model:
    """Fit on labelled documents that are not held out: a label's distinct texts in order of their hash, each whole, up to `sample` of them and until those taken hold `most_bytes`; of more than `most_labels` labels those with the most distinct texts. Copies of a text count once."""
    spark = docs.sparkSession
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text", F.xxhash64("text").alias("h"))
    u = F.pmod(F.col("h"), F.lit(1 << 30))
    hashes = materialize(usable.select("lang", "h", F.octet_length("text").alias("size")).distinct().select("lang", "h", "size", u.alias("u"), F.floor(16 * F.log2(u + 1)).cast("int").alias("bin")), "hashes")
    labels = [r["lang"] for r in hashes.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_labels).collect()]
    if not labels:
        return Model([], np.zeros((_SLOTS + _LEXICON, 0), np.float32), np.zeros((0, 0)))
    own = hashes.where(F.col("lang").isin(labels))
    # counts in bins of growing width give a cut for each label with at least `sample` hashes under it (all if fewer) and few more
    cuts, under = {}, {}
    for lang, bin, n in sorted(tuple(r) for r in own.groupBy("lang", "bin").count().collect()):  # at most 481 rows a label
        if under.get(lang, 0) < sample:
            cuts[lang], under[lang] = bin, under.get(lang, 0) + n
    near: dict[str, list] = {lang: [] for lang in cuts}
    limits = F.broadcast(spark.createDataFrame(list(cuts.items()), "lang string, cut int"))
    for r in own.join(limits, "lang").where("bin <= cut").select("lang", "u", "h", "size").collect():
        near[r["lang"]].append((r["u"], r["h"], r["size"]))
    chosen = []
    for lang, found in near.items():
        taken = 0
        for _, h, size in sorted(found)[:sample]:
            if taken < most_bytes:
                chosen.append((lang, h))
                taken += size
    picked = F.broadcast(spark.createDataFrame(chosen, "lang string, h long"))  # at most sample rows a label
    rows = usable.join(picked, ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "text", u.alias("u"), "h").collect()
    return fit([(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["lang"], r["u"], r["h"]))])


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """keep columns (doc_id) with lang_pred and score."""
    keep = keep or ["doc_id"]
    names = [c for c in keep if c not in ("lang_pred", "score")]
    sent = names if "text" in names else [*names, "text"]  # the text travels once
    df = docs.select(*[F.col(f"`{c}`") for c in sent])
    at = sent.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[: len(names)]] + ["lang_pred string", "score double"])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            data, offsets = tb.utf8(batch.column(at))
            for first, last in tb.runs(offsets):
                pred, score, _ = judge(own, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                for i, p in enumerate(pred.tolist()):
                    if p >= 0 and not _lettered(data[offsets[first + i] : offsets[first + i + 1]]):
                        pred[i], score[i] = -1, 0.0
                langs = [own.labels[p] if p >= 0 else "und" for p in pred.tolist()]
                columns = [c.slice(first, last - first) for c in batch.columns[: len(names)]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    return df.mapInArrow(tidy(label), schema)


def _lettered(data: np.ndarray) -> bool:
    head = data[:4096]
    if (((head | 32) >= 97) & ((head | 32) <= 122)).any():
        return True
    return any(c.isalpha() for c in data.tobytes().decode())


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the documents that are not held out."""
    found = identify(docs, learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
