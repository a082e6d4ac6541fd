"""Token counts (2), packing (6) and id files (8) against whole-text calls of the tokenizers library."""

import collections
import random
import tempfile
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from beamframe.llm import encode, packing, token_files, token_spans
from beamframe.llm.encode import Encoder, vocabulary
from tests.llm.cases import clash, odd_docs, text

BYTES, WORD = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")


def plain(path):
    return Tokenizer.from_file(path)


@pytest.mark.parametrize("path", [BYTES, WORD])
def test_encoder_is_the_library(path):
    t = plain(path)
    texts = [text(n, n) for n in range(60)] + ["", " ", "\n\n a", "a  b\t\tc ", "x\x1cy\x85z", "a\u3000b\u00a0c", "don't WE'LL 's  's", "A\u0301 \u0301b", "\r\n\r\nq", "ab\u200b \u200bcd", "<|endoftext|>", "ΑΣ Σ"]
    assert Encoder.of(path).encode(texts) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


@settings(max_examples=150, deadline=None)
@given(st.text())
def test_encoder_on_any_text(x):
    for path in (BYTES, WORD):
        whole = plain_cached(path).encode(x, add_special_tokens=False)
        assert Encoder.of(path).encode([x])[0] == np.array(whole.ids, "<u4").tobytes()
    assert Encoder.of(BYTES).offsets([x])[0].tolist() == [list(s) for s in plain_cached(BYTES).encode(x, add_special_tokens=False).offsets]


_PLAIN: dict = {}


def plain_cached(path):
    if path not in _PLAIN:
        _PLAIN[path] = plain(path)
    return _PLAIN[path]


@pytest.mark.parametrize("rule", token_spans.RULES)
def test_sections_by_brute_force(spark, rule):
    docs = clash(odd_docs(spark), "field", "start")
    got = collections.Counter((r.doc_id, r.field, r.section, r.start, r.end, r.n_tokens, r.n_crossing) for r in token_spans.attribute_tokens(docs, BYTES, ["source", "text"], rule=rule).collect())
    t, want = plain(BYTES), collections.Counter()
    for d in docs.collect():
        fields = [("source", (d.source or "") + "\n"), ("text", d.text or "")]
        sections, at = [], 0
        for name, value in fields:
            pieces = value.splitlines(keepends=True) if False else [p for p in __import__("re").findall(r"[^\n]*\n|[^\n]+", value)] or [""]
            for k, p in enumerate(pieces):
                sections.append((name, k, at, at + len(p)))
                at += len(p)
        n, crossing = [0] * len(sections), [0] * len(sections)
        for a, b in t.encode("".join(v for _, v in fields), add_special_tokens=False).offsets:
            over = [(max(0, min(b, e) - max(a, s)), -i) for i, (_, _, s, e) in enumerate(sections)]
            hit = [i for i, (_, _, s, e) in enumerate(sections) if s <= a and (a < e or i == len(sections) - 1)][-1:]
            last = [i for i, (_, _, s, e) in enumerate(sections) if s <= max(a, b - 1) and (max(a, b - 1) < e or i == len(sections) - 1)][-1]
            own = {"first": hit[0], "last": last, "most": -max(over)[1] if b > a else hit[0]}[rule]
            n[own] += 1
            crossing[own] += hit[0] != last
        want.update((d.doc_id, f, k, s, e, n[i], crossing[i]) for i, (f, k, s, e) in enumerate(sections))
    assert got == want


def test_sections_of_no_rows(spark):
    assert token_spans.attribute_tokens(odd_docs(spark).limit(0), BYTES, ["text"]).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plan_fills_each_place_once(counts):
    runs = packing.plan_best_fit(counts, 64)
    taken, ranks = collections.defaultdict(list), collections.Counter()
    for length, rank, n, first, offset in runs:
        ranks.update((length, r) for r in range(rank, rank + n))
        for s in range(first, first + n):
            taken[s].append((offset, length))
    assert ranks == collections.Counter((k, r) for k, n in counts.items() for r in range(n))
    for own in taken.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    plain_bins = []
    for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        fits = [i for i, r in enumerate(plain_bins) if r >= length]
        if fits:
            plain_bins[min(fits, key=lambda i: plain_bins[i])] -= length
        else:
            plain_bins.append(64 - length)
    assert len(taken) == len(plain_bins)


def test_packing_by_brute_force(spark):
    docs = clash(odd_docs(spark), "piece", "length", "sequence_id").repartition(3)
    rows = packing.pack(docs, BYTES, size=128, with_ids=True).collect()
    t, want = plain(BYTES), collections.Counter()
    for d in docs.collect():
        ids = [*t.encode(d.text or "", add_special_tokens=False).ids, 2]
        for k, (s, n) in enumerate(packing.cut(len(ids), 128)):
            want[d.doc_id, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())] += 1
    assert want == collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert all(len(r.ids) == r.length for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 128
    assert len(by) <= 1.1 * sum(r.length for r in rows) / 128 + 1
    assert packing.pack(docs.limit(0), BYTES).count() == 0


def test_packing_encodes_bounded_bytes_at_once(spark, monkeypatch):
    """2048 texts of 4,000 bytes went to the encoder at once."""
    frame, sent = SimpleNamespace(select=lambda *_: frame, mapInArrow=lambda work, _: work), []
    encode = packing.Encoder.encode
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(packing.Encoder, "encode", lambda self, texts: sent.append([len(t or "") for t in texts.to_pylist()]) or encode(self, texts))
    texts = ["ab c" * 1000] * 300 + [None, "", "x y" * 200_000, None] + ["d e " * 1000] * 100
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    out = pa.Table.from_batches(packing.pieces(frame, BYTES, 1024, 2, True, True)(iter([batch.slice(0, 250), batch.slice(250)])))
    assert sum(map(len, sent)) == len(texts) and max(sum(x) for x in sent if len(x) > 1) <= packing.tb.RUN_BYTES
    assert sorted(set(out["doc_id"].to_pylist())) == list(range(len(texts))) and out.schema.names[-1] == "ids"


def test_cut():
    assert packing.cut(1024, 1024) == [(0, 1024)] and packing.cut(2050, 1024) == [(0, 2), (2, 1024), (1026, 1024)] and packing.cut(2048, 1024) == [(0, 1024), (1024, 1024)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=300))
def test_elias_fano_round_trip(steps):
    values = np.cumsum(np.array(steps, np.int64))
    seq = token_files.EliasFano.build(values)
    again = token_files.EliasFano.of_parts(seq.n, seq.bits, *seq.parts())
    assert again.select_range(0, len(values)).tolist() == values.tolist()
    for a, b in ((0, 1), (len(values) // 3, len(values)), (len(values) // 2, len(values) // 2 + 1), (63, 129), (5, 5)):
        assert again.select_range(min(a, len(values)), min(b, len(values))).tolist() == values[a:b].tolist()
    assert [again.select(i) for i in range(len(values))] == values.tolist()


@pytest.mark.parametrize("path,shards", [(BYTES, 3), (WORD, None)])
def test_token_files_round_trip(spark, path, shards):
    docs = clash(odd_docs(spark), "start")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    manifest = spark.createDataFrame(token_files.write_token_files(docs, folder, path, 1, shards).collect())
    rows = token_files.read_token_files(manifest, folder, with_ids=True).collect()
    t = plain(path)
    want = collections.Counter((d.doc_id, tuple([*t.encode(d.text or "", add_special_tokens=False).ids, 1])) for d in docs.collect())
    assert want == collections.Counter((r.doc_id, tuple(r.ids)) for r in rows)
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    ids = [r.doc_id if r.doc_id is not None else -1 for r in sorted(rows, key=lambda r: r.start)]
    assert ids == sorted(ids)


def test_token_files_of_no_rows(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    assert token_files.write_token_files(odd_docs(spark).limit(0), folder, BYTES).count() == 0


def test_boundaries_take_little_space():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 10_000))
    assert sum(map(len, token_files.EliasFano.build(ends).parts())) < 10_000 * 2


def test_random_select():
    values = sorted(random.Random(3).choices(range(10**9), k=5000))
    seq = token_files.EliasFano.build(np.array(values))
    assert all(seq.select(i) == values[i] for i in range(0, 5000, 37))


@pytest.mark.parametrize("path", [BYTES, WORD])
def test_every_character_before_punctuation(path):
    t = plain_cached(path)
    chars = [chr(c) for c in [*range(1, 0xD800), *range(0xE000, 0x11000), *range(0x1D000, 0x1F000)]]
    texts = [" ".join(f"x{c},y {c}. {c}" for c in chars[at : at + 256]) for at in range(0, len(chars), 256)]
    texts += [f"x{c},y" for c in chars if len(c.lower()) > 1 or c in "\u0958\u09dc\u0344\ufb1d"]
    for text, got in zip(texts, Encoder.of(path).encode(texts), strict=True):
        assert got == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


@pytest.mark.parametrize("path", [BYTES, WORD])
def test_special_tokens_and_runs_of_spaces(path):
    t = plain_cached(path)
    texts = ["hi <|endoftext|> x", "<|startoftext|>a, b", "a<|endoftext|>", "  a", "   a", "a   b", "a  ", "a \n b", "a\n  b", "a \n", " ", "  ", "x\n ", "a\t \tb", " \n", "\n a", "a\u3000 b", "a \u3000 b"]
    assert Encoder.of(path).encode(texts) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert [x.tolist() for x in Encoder.of(BYTES).offsets(texts)] == [[list(s) for s in plain_cached(BYTES).encode(x, add_special_tokens=False).offsets] for x in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t.,a\u0130\u00e9Z1_'s<|>", max_size=30))
def test_encoder_on_spaces_and_punctuation(x):
    for path in (BYTES, WORD):
        assert Encoder.of(path).encode([x])[0] == np.array(plain_cached(path).encode(x, add_special_tokens=False).ids, "<u4").tobytes()


def test_marks_in_texts():
    texts = ["a \x01 b \x01", " \x01x, y", "q \x01,"]
    for path in (BYTES, WORD):
        t = plain_cached(path)
        assert Encoder.of(path).encode(texts) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_rare_words_go_before_words_met_again():
    kept = encode.Kept(4)
    kept.add({"a": b"1", "b": b"2"})
    assert kept.find(["a", "x"]) == {"a": b"1"}
    for k in range(40):
        kept.add({f"rare{k}": b""})
    assert kept.find(["a", "b", "rare39"]) == {"a": b"1", "rare39": b""} and len(kept) <= 8


def test_few_words_kept_give_the_same_ids():
    texts = [text(n, n) for n in range(60)] + ["", " a b", "a  b", "x<|endoftext|>y"]
    small = encode.Encoder(BYTES, 3)
    assert [small.encode(texts[k : k + 5]) for k in range(0, 60, 5)] == [Encoder.of(BYTES).encode(texts[k : k + 5]) for k in range(0, 60, 5)]
    assert len(small.pieces) <= 4 * max(map(len, texts)) and small.encode(texts) == Encoder.of(BYTES).encode(texts)


def test_a_task_that_gives_back_keeps_no_words_or_tokenizer(monkeypatch):
    loaded = {}
    monkeypatch.setattr(encode, "_LOADED", loaded)
    assert Encoder.of(BYTES, 5).pieces.most == 5 and loaded
    Encoder.give_back(BYTES)
    assert not loaded


PLAIN = "It's we'll THEY'VE don'T 'tis rock''s,\nand 12ab3 (x) [y]...\t\tEnd.\r\n\r\nÀé ñoño, ǅ ǃa ɏ. x$$$ #a% *b*\n \n q\n"


def test_plain_parts_go_to_the_model(monkeypatch):
    fresh = encode.Encoder(BYTES)
    monkeypatch.setattr(fresh, "_bytes", lambda texts: pytest.fail(f"encoded in full: {texts}"))
    texts = [text(n, n) for n in range(60) if text(n, n).isascii()] + [PLAIN, "", None]
    t = plain_cached(BYTES)
    assert fresh.encode(pa.array(texts)) == [np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert encode.Encoder(WORD).model is None


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="".join(map(chr, [*range(1, 127), 0xAA, 0xB5, 0xC0, 0xD7, 0xDF, 0xF7, 0xFF, 0x1C5, 0x24F, 0x250, 0x301, 0x3000])) + " " * 40 + "''ssltlevre\n\n", max_size=40))
def test_encoder_on_plain_text(x):
    got = Encoder.of(BYTES).encode([x, PLAIN + x])
    assert got == [np.array(plain_cached(BYTES).encode(y, add_special_tokens=False).ids, "<u4").tobytes() for y in (x, PLAIN + x)]


def test_spaces_are_those_of_python():
    for c in [*map(chr, range(1, 0xD800)), *map(chr, range(0xE000, 0x10000))]:
        assert (c in encode._SPACE) == (encode.re.fullmatch(r"\s", c) is not None)
    texts = [f"a{c} b" + end for c in encode._SPACE for end in ("", f"{c} ", f"{c}  b")]
    for path in (BYTES, WORD):
        assert Encoder.of(path).encode(texts) == [np.array(plain_cached(path).encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="".join(map(chr, [*range(1, 0x1C), *range(33, 128), 0xC0, 0xD7, 0xF7, 0xFF, 0x23F])) + "\n\n\tabc12..", max_size=12), min_size=1, max_size=6))
def test_units_are_cut_where_the_pattern_cuts(units):
    data = [(" " + u).encode() for u in units]
    starts = encode._cut(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    want, at = [], 0
    for u, raw in zip(units, data, strict=True):
        parts = [" " + u] if set(u) & set("'×÷") else encode._BYTE_PART.findall(" " + u)
        for p in parts:
            want.append(at)
            at += len(p.encode())
    assert starts.tolist() == want
    assert Encoder.of(BYTES).encode([" ".join(["", *units])])[0] == np.array(plain_cached(BYTES).encode(" ".join(["", *units]), add_special_tokens=False).ids, "<u4").tobytes()
